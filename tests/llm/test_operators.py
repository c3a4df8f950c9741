"""Each operator against a brute-force version on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, cap_dedup, common, html_extract, line_dedup, ngram_join, packing, quality, surrogates, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)], DOCS)


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(n // 3)]
    out = list(base)
    for t in base:
        w = t.split()
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append(" ".join(v))
    return [*out, None, "", "  \n\t", "one", "One", "a b c", "A B C", "x " * 3000, base[0]]


def brute_components(rows, k, t):
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

    def shingles(x):
        w = WORD.findall((x or "").translate(fold))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets, root = [shingles(x) for x in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) * 100 >= round(100 * t) * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return sets, root


@pytest.mark.parametrize("k,t,long_list", [(4, 0.85, 32), (5, 0.8, 2), (2, 0.5, 1)])
def test_ngram_join(spark, k, t, long_list):
    rows = texts()
    sets, root = brute_components(rows, k, t)
    got = {r.doc_id: r for r in ngram_join.link_components(docs(spark, rows), k, t, long_list).collect()}
    assert [got[i].component_id for i in range(len(rows))] == root
    assert [got[i].n_shingles for i in range(len(rows))] == [len(s) for s in sets]


def chains(n=120, seed=3):
    """Texts on a common passage; each replaces some words of an earlier one, so that few pairs of a list link."""
    rng = random.Random(seed)
    passage, out = [f"w{i}" for i in range(60)], []
    for i in range(n):
        words = list(rng.choice(out).split()) if out and i % 3 else list(passage)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(50)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k,t,block", [(2, 0.9, 16), (4, 0.75, 16), (4, 0.85, 40)])
def test_ngram_join_block_against_block(spark, k, t, block):
    rows = chains()
    sets, root = brute_components(rows, k, t)
    assert 1 < len(set(root)) < len(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(docs(spark, rows), k, t, 2, 1, block).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_ngram_join_empty_null_and_repeated_ids(spark):
    assert ngram_join.link_components(docs(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l")]
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 0.85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (3, 3), (5, 3), (5, 3), (9, 3)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1000, 1100)} == {1000}


def test_url_filter(spark):
    rules = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("allow", "org", "/fr/")]
    urls = ["http://A.Example.NET/en/x?q", "https://b.net", "https://b.net/", "http://xnet/en/", "http://cheappills.org/de/", "http://x.org/fr/#a", None, "nothing", "http://blog.news.com/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [tuple(r)[2:5] + (r.verdict,) for r in url_filter.judge(rows, rules).orderBy("page_id").collect()]
    assert [(h, p, r) for h, p, r, _ in got] == [("a.example.net", "/en/x", "example.net/en/"), ("b.net", "", None), ("b.net", "/", "net/"), ("xnet", "/en/", None), ("cheappills.org", "/de/", None), ("x.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("blog.news.com", "/en/", None)]
    assert [v for *_, v in got] == ["allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert url_filter.judge(rows.limit(0), rules).count() == 0


def test_segmentation_is_the_cheapest_split():
    cost = {"cheap": 2.0, "pills": 2.0, "he": 1.5, "cheappi": 5.0}
    assert url_filter.segment("cheappills", cost, 9.0) == ["cheap", "pills"] and url_filter.segment("xxcheap", cost, 9.0) == ["xx", "cheap"]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.05 * rng.standard_normal(16)).astype("f4").tolist(), i % 2 if i % 7 else None) for i in range(160)]
    rows += [(160, rows[1][1], 1), (161, None, 1), (162, [0.0] * 16, 1), (163, [float("nan")] * 16, 1), (164, [], 1)]
    got = {r.vec_id: r for r in cap_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98, block=8).collect()}
    ok = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([r[1] for r in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    want = {r[0]: int(n) - 1 for r, n in zip(ok, near.sum(1))}
    found = sum(got[i].n_links for i in want)
    assert sum(want.values()) > 50 and found >= 0.97 * sum(want.values()) and all(got[i].n_links <= n for i, n in want.items())
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (161, 162, 163, 164))


def test_vectors_of_repeated_ids_and_extreme_doubles(spark):
    rows = [(1, [1.0, 0, 0, 0], 1), (1, [0, 1.0, 0, 0], 1), (3, [1.0, 0.01, 0, 0], 1), (4, [0.01, 1.0, 0, 0], 1), (5, [1e300, 1e300, 0, 0], 2), (6, [1e-60, 1e-60, 0, 0], 2), (7, [1e-60, 1e-60], 2), (None, [1.0, 0, 0, 0], 1), (9, [1.0, None, 0, 0], 1)]
    rows = [(a, [x if x is None else float(x) for x in b], c, 0) for a, b, c in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    got = sorted(tuple(r) for r in cap_dedup.link_vectors(table).collect() if r.vec_id is not None)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 1, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (9, 0, 9, True)]
    assert cap_dedup.link_vectors(table.limit(0)).count() == 0


def test_vectors_against_brute_force_on_a_hot_cluster(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1, 64)) + 0.05 * rng.standard_normal((200, 64)), rng.standard_normal((300, 64))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in cap_dedup.link_vectors(table, block=64).collect()}
    u = cap_dedup.unit(x)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert want.sum() > 10_000 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_vectors_share_filters_at_sizes_beyond_four_million():
    rng = np.random.default_rng(9)
    x, z = rng.standard_normal((2, 300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    shared, some = np.zeros(300, bool), np.zeros(300, bool)
    for i in range(cap_dedup.CODES):
        code = cap_dedup.ProductCode.of(64, 5_000_000, cap_dedup.PASSED, i)
        a, b = code.passed_by(x), code.passed_by(y)
        shared |= [len(np.intersect1d(f, g)) > 0 for f, g in zip(a, b)]
        some |= [len(f) > 0 for f in a]
    assert some.all() and shared.mean() >= 0.98


def test_surrogates(spark):
    rows = ["Mail a.b7@mail1.example.com or A.B7@mail1.example.com, call +1 (743) 555-3824 4539578763621486.", "Mrs Jane Miller met Mr. Miller; Frau Müller; 10.20.30.40 and token \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\"", None, "", "clean text", "+17435553824", "г-н Иван Петров"]
    got = [r.text for r in surrogates.replace(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got[2:5] == [None, "", "clean text"] and "4539578763621486" not in got[0] and "555-3824" not in got[0]
    mails = re.findall(r"\S+@\S+[a-z]", got[0])
    assert mails[0].lower() == mails[1].lower() != "a.b7@mail1.example.com" and mails[1][0].isupper()
    assert re.sub(r"\D", "", re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0])[0]) == re.sub(r"\D", "", got[5])
    card = [int(c) for c in re.findall(r"\d{16}", got[0])[0]][::-1]
    assert sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(card)) % 10 == 0
    first, second = re.search(r"Mrs (\w+) (\w+) met Mr. (\w+);", got[1]).groups()[1:]
    assert first == second != "Miller" and re.search(r"[А-я]+ [А-я]+$", got[6]) and "Петров" not in got[6]
    many = spark.createDataFrame([(f"ip|{i % 256}.{i // 256}.1.2",) for i in range(3000)] + [(f"given_latin_{'mf'[i % 2]}|n{i}",) for i in range(200)], "entity string")
    made = surrogates.surrogates(many, "k").collect()
    assert len({(r.entity.split("|")[0].rstrip("_mf"), r.surrogate.lower()) for r in made}) == len(made) == 3200


def test_surrogates_keep_persons_apart_and_together(spark):
    rows = ["Dr. Anna Schmidt met Frau Anna Schmidt. Schmidt said hi to Anna.", "Contact John Smith, 12 Main Street, born 1980-02-03. Smith left.", "Mr Κώστας Γεωργίου; а.иванов@почта.рф", "hex " + "ab12" * 60, "Herr A" + "b" * 60 + " ok", "see (743) 555-3824", None, "", "clean " * 20_000, "Schmidt alone"]
    table = spark.createDataFrame([(i % 8, t, 1, 2, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_entities int, hits int, `a.b` string")
    got = surrogates.replace(table)
    assert got.columns == [*table.columns, "n_entities_1"] and surrogates.replace(table, counts=False).columns == table.columns
    out = {r.n_entities_1 * 1000 + i: r for i, r in enumerate(got.collect())}
    texts = [r.text for r in out.values()]
    first = next(t for t in texts if t and "said hi to" in t)
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met Frau (\w+) (\w+)\. (\w+) said hi to (\w+)\.", first).groups()
    assert m[0] == m[2] == m[5] != "Anna" and m[1] == m[3] == m[4] != "Schmidt" and m[0] in surrogates.GIVEN["latin", "f"]
    second = next(t for t in texts if t and t.startswith("Contact"))
    m = re.fullmatch(r"Contact (\w+) (\w+), (\d\d) (\w+) Street, born (\d{4})-(\d\d)-(\d\d)\. (\w+) left\.", second).groups()
    assert m[1] == m[7] != "Smith" and "Main" not in second and "1980-02-03" not in second and 1 <= int(m[5]) <= 12 and 1 <= int(m[6]) <= 28
    assert any(t and re.search(r"^Mr [Α-Ωα-ωά-ώΆ-Ώ]+ [Α-Ωα-ωά-ώ]+; [а-я]\.[а-я]+@[а-я]+\.рф$", t) for t in texts)
    assert "clean " * 20_000 in texts and None in texts and "" in texts and "Schmidt alone" in texts and not any(t and ("ab12" in t or "bbb" in t or "555-3824" in t) for t in texts)
    assert all((r.hits, r["a.b"], r.n_entities) == (2, "x", 1) for r in out.values()) and surrogates.replace(table.limit(0)).count() == 0


def test_surrogates_of_a_used_up_format(spark):
    made = surrogates.surrogates(spark.createDataFrame([(f"phone|{i}",) for i in range(1, 31)], "entity string"), "k").collect()
    assert len({r.surrogate for r in made}) == len(made) == 30 and not {r.surrogate for r in made} & {str(i) for i in range(1, 31)}


def test_quality(spark):
    rows = [*texts(30), "w*** " * 80, "A b c.\nA b c.\nd"]
    got = {r.doc_id: r for r in quality.score(docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        cover = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.score(docs(spark, [])).count() == 0


def test_toxicity_learns_and_carries_over_to_misspellings(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=80)
        if i % 4 == 0:
            for at in rng.sample(range(80), 4):
                w[at] = rng.choice(["zorkwit", "zorkwits", "zorkwitty"])
        rows.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [None, "", "the zorkwiting one"]
    d = docs(spark, rows)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = {r.doc_id for r in d.where(~toxicity.learnable(F.col("doc_id"))).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held if i < 400]) > 0.95
    assert got[402] >= 0.3 > got[400] == got[401] and toxicity.score(d.limit(0), model).count() == 0
    assert {r.doc_id for r in toxicity.without_toxic(d, model).collect()} == {i for i, s in got.items() if s < 0.3}


def brute_lines(rows, least=line_dedup.LEAST_WORDS, share=line_dedup.SHARE):
    """rows of (doc_id, text) in the order of their places; the texts left."""
    seen, out = [], []
    for t in rows:
        keep = []
        for x in (t or "").split("\n"):
            w = x.split(" ")
            if WORD.search(x):
                alike = False
                for v in seen:
                    if v == w:
                        alike = True
                    elif min(sum(bool(WORD.search(y)) for y in u) for u in (v, w)) >= least and abs(len(v) - len(w)) <= 1:
                        a, b = (v, w) if len(v) >= len(w) else (w, v)
                        fits = lambda u, i: share * len(u[i]) <= sum(map(len, u)) - len(u[i])
                        if len(a) > len(b):
                            alike |= any(a[:i] + a[i + 1 :] == b and fits(a, i) for i in range(len(a)))
                        else:
                            differs = [i for i in range(len(a)) if a[i] != b[i]]
                            alike |= len(differs) == 1 and fits(a, differs[0]) and fits(b, differs[0])
                seen.append(w)
                if alike:
                    continue
            keep.append(x)
        out.append(None if t is None else "\n".join(keep))
    return out


@pytest.mark.parametrize("least", [4, 8])
def test_line_dedup(spark, least):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(10)] + ["long" * 3, "", "longer" * 5]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(80)]
    for _ in range(160):  # with an edit anywhere, so that they share the first half, the last half, both or neither
        w = rng.choice(lines).split(" ")
        i = rng.randrange(len(w))
        w[i : i + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
        lines.append(" ".join(w))
    rows = ["\n".join(rng.choices(lines, k=5) + ["", " "]) for _ in range(90)] + [None, "", "\n", "\n".join(lines[:20]) * 30]
    want = brute_lines(rows, least)
    assert sum(len(x or "") for x in want) < sum(len(x or "") for x in brute_lines(rows, 1000))
    got = line_dedup.dedup_lines(docs(spark, rows), least).orderBy("doc_id").collect()
    assert [r.text for r in got] == want and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_leaves_short_lines_that_are_not_equal(spark):
    long = "a b c d e f g h i j"
    rows = ["Thing.\nDie.\nPation.\none two\none three\none\nHello\nWorld\nYes\nNo\nBest wishes\nBest regards\nTotal 7\nTotal 5", f"Die.\n{long}\na b c d e f g\n{long} k\n{long} kkkkkkkkkk", f"        x\n        y\n{long.replace('d', 'z')}"]
    got = [r.text for r in line_dedup.dedup_lines(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == [rows[0], f"{long}\na b c d e f g\n{long} kkkkkkkkkk", "        x\n        y"]


def test_line_dedup_of_repeated_and_null_ids_and_clashing_columns(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, "same\nown a"), (None, "same\nown b"), (1, "same"), (1, f"{line} a\nsame"), (1, f"{line} b"), (2, "twice"), (2, "twice")]
    table = spark.createDataFrame([(*r, 7, 8, 9, "x") for r in rows], "doc_id long, text string, n_lines int, _gone int, o int, `a.b` string")
    got = line_dedup.dedup_lines(table)
    assert got.columns == ["doc_id", "text", "n_lines", "_gone", "o", "a.b", "n_lines_1", "n_removed"]
    got = got.collect()
    assert all(tuple(r)[2:6] == (7, 8, 9, "x") for r in got) and len(got) == len(rows)
    texts = [r.text for r in got]
    assert sum(t.count("same") for t in texts) == 1 and sum(line in t for t in texts) == 1 and texts.count("twice") == 2
    assert [r.text.split("\n")[-1] for r in got if r.doc_id is None] == ["own a", "own b"] or [r.text.split("\n")[-1] for r in got if r.doc_id is None] == ["own b", "own a"]
    assert line_dedup.dedup_lines(table, counts=False).columns == table.columns


def test_packing(spark):
    rows = [*texts(90), "long " * 5000]
    got = packing.pack(docs(spark, rows), PATH, capacity=256, rounds=40, buckets=4).toPandas()
    ids = {i: Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(rows)}
    for i, g in got.sort_values("piece").groupby("doc_id"):
        assert g.length.sum() == len(ids[i]) and list(g.start) == [0, *g.length.cumsum()[:-1]] and (len(ids[i]) > 256 or len(g) == 1)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 256
    assert set(got.doc_id) == set(ids) and got.sequence_id.nunique() <= 1.1 * got.length.sum() / 256 + 2
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_of_blank_runs_and_null_ids(spark):
    rows = [(None, " " * 300_000), (1, " \n" * 200_000), (1, None), (None, "a b")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, rounds=20).toPandas()
    t = Tokenizer.from_file(PATH)
    assert got.length.sum() == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    assert (got.groupby("sequence_id").length.sum() <= 2048).all() and got.offset.min() == 0


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>menu</ul></nav><div class='cookie-notice'>ok</div><article><h1>He&amp;ad</h1><p>one <b>two</b><p>three<br>four<script>var a='</p>'</script><form>f</form><div class=comments>bad</div></article><aside>s</aside><footer>&copy; f</footer></body></html>"
    bare = "<body><p>Boiler plate</p><p>story {}</p></body>"
    rows = [(0, "http://a/1", page), (1, None, None), (2, "u", ""), *((i, f"http://b/{i}", bare.format(i)) for i in range(3, 8))]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "He&ad\n\none two\n\nthree four" and got[0].n_chars == len(got[0].text)
    assert got[1].text == got[2].text == "" and [got[i].text for i in range(3, 8)] == [f"story {i}" for i in range(3, 8)]


def brute_template(pages):
    """Texts of the valid classes, by the definition, for the pages of one host."""
    lists = [html_extract.page_tokens(p) for p in dict.fromkeys(pages)]
    vector = {t: tuple(x.count(t) for x in lists) for x in lists for t in x}
    classes = {}
    for t, v in vector.items():
        if sum(n > 0 for n in v) >= 0.5 * len(lists):
            classes.setdefault(v, set()).add(t)
    classes = {v: c for v, c in classes.items() if len(c) > 1}
    once = [v for v in classes if max(v) == 1]
    root = classes[max(once, key=lambda v: (all(v), len(classes[v])))] if once else set()
    out = set()
    for v, c in classes.items():
        orders, gaps = set(), set()
        for x in lists:
            own = [t for t in x if t in c]
            if own:
                period = list(dict.fromkeys(own))
                orders.add(tuple(period) if own == period * (len(own) // len(period)) else object())
                last, at = 0, set()
                for t in x:
                    if t in c:
                        at.add(last)
                    last = t if t in root else last
                gaps.add(0 if c is root else frozenset(at))
        if len(orders) == len(gaps) == 1:
            out |= {t for t in c if t & 1}
    return out


def test_html_without_article_by_template(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    pages, want = [], []
    for i in range(12):
        story = [" ".join(word() for _ in range(12)) for _ in range(1 + i % 4)]
        items = "".join(f"<div class=q><div>By</div><p>{x}</p><div>Read on</div></div>" for x in story)
        pages.append(f"<html><body><div class=a><div>Our site</div><div>Start</div><div>All</div></div><div class=b>{items}</div><div class=c><div>Made by us</div></div></body></html>")
        want.append("\n\n".join(story))
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate(pages)] + [(100, "http://h/again", pages[0]), (101, "http://two/1", pages[1]), (102, "http://two/2", pages[2]), (103, "http://one/", "<p>only</p>")]
    rows += [(110 + i, f"http://copies/{i}", f"<body><div>Top</div><article><p>{'same long text ' * 20}</p><p>{i}</p></article></body>") for i in range(5)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, template string")
    got = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    assert [got[i] for i in range(12)] == want and got[100] == want[0] and got[103] == "only" and "Our site" in got[101] and got[112].endswith("\n\n2") and "same long text" in got[112]
    deduced = {r.host: set(r.template) for r in html_extract.deduce(table.selectExpr("split(url, '/')[2] host", "html")).collect()}
    assert deduced["h"] == brute_template(pages) and not {"two", "one"} & set(deduced)
    assert html_extract.main_text(table.limit(0)).count() == 0


def test_html_drops_nothing_else_of_an_article(spark):
    page = "<article><p class='related-work'>a</p><math>m</math><p hidden>b</p><p class='ad-box'>no</p><div id=comment-list>no</div><p class=notice>no</p><p>" + "long " * 50_000 + "</p></article><p>out</p>"
    got = html_extract.main_text(spark.createDataFrame([(1, "http://a/", page)], "page_id int, url string, html string")).first()
    assert got.text == "a\n\nm\n\nb\n\n" + ("long " * 50_000).strip()


def test_url_filter_words_and_clashing_columns(spark):
    rows = [(i, f"http://spam-farm.example.com/news/{i}", "<title>example spam farm tion</title>", 5, 6) for i in range(3)] + [(9, "http://exampletion.org/en/", None, 5, 6), (9, "x" * 5000 + "://" + "tion" * 2000 + ".net/", "", 5, 6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, _host int, score int")
    got = url_filter.judge(table, [])
    assert got.columns == ["page_id", "url", "html", "_host", "score", "host", "path", "rule", "verdict", "block_odds", "words"]
    got = got.orderBy("page_id").collect()
    assert got[0].words == "spam farm example com news 0" and got[0].verdict == "block" and {r.words for r in got if r.url.startswith("http://ex")} == {"example tion org en"}
    assert len(got) == 5 and all((r._host, r.score) == (5, 6) for r in got) and set(url_filter.lexicon(table)) == {"example", "spam", "farm", "tion"}


def test_url_filter_bayes_by_brute_force():
    model = url_filter.train({"tion": 3})
    bad, good = ([w for line in x for w in line.split()] for x in (url_filter.BAD, url_filter.GOOD))
    size = len({*bad, *good})
    odds = math.log(len(url_filter.BAD) / len(url_filter.GOOD)) - math.log(3)
    for w in ("spam", "farm", "news"):
        odds += math.log((bad.count(w) + 1) / (len(bad) + size)) - math.log((good.count(w) + 1) / (len(good) + size))
    assert abs(model.odds("spamfarm.tion", "/news/7") - odds) < 1e-9


def test_bpe(spark):
    t = Tokenizer.from_file(PATH)
    rows = [*texts(20), "It's 3.14 <|endoftext|> ünïcode 日本 🎉\x00\r\n  ", "a" * 3000]
    got = {r.doc_id: r for r in bpe.digests(docs(spark, rows), PATH).collect()}
    for i, x in enumerate(rows):
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda y: hashlib.sha256(y.encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(docs(spark, rows), PATH), PATH).collect()
    assert all(r.text == (rows[r.doc_id] or "") for r in back)
