"""run() against a plain chain on a small table, and the stages on awkward rows."""

import random
import zlib

import numpy as np
import pytest
from test_operators import PATH, brute_components, brute_lines
from tokenizers import Tokenizer

from quire.llm import surrogates, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    shared, rows = line(60), []
    for i in range(120):
        text = "\n".join(line(12) for _ in range(5))
        if i % 6 == 0:
            w = text.split(" ")
            for at in rng.sample(range(len(w)), 8):
                w[at] = "zorkwits"
            text = " ".join(w)
        if i % 5 == 0:
            text += "\n" + shared
        if i % 10 == 3:
            text = text.replace("\n", " ") + f" Mr John Miller{'abcdefghijkl'[i // 10]}son, john{i}@mail.example.com"
        rows.append((i, text))
    near = rows[13][1].split(" ")
    near[20] = "changed"
    rows += [(200, " ".join(near)), (201, rows[23][1]), (202, ""), (203, None), (204, "one"), (205, "x " * 5000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_run(spark, tmp_path):
    rows = table(spark, str(tmp_path))
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    left = [(r[0], r[1]) for r, s in zip(rows, model.scores([r[1] or "" for r in rows])) if s < 0.3]
    assert 90 < len(left) < 115
    left = list(zip([i for i, _ in left], brute_lines([t for _, t in left])))
    _, root = brute_components([t for _, t in left], 5, 0.8)
    left = [x for k, x in enumerate(left) if root[k] == k]
    made = surrogates.replace(spark.createDataFrame([(*x, "en", "s", 0) for x in left], SCHEMA), counts=False).collect()
    assert len(made) == len(left) and sum(r.text != t for r, (_, t) in zip(sorted(made), sorted(left, key=lambda x: x[0]))) >= 10
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for r in made:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        want[r.doc_id] = [zlib.crc32(ids[max(a, 0) : a + 2048].tobytes()) for a in range(first - 2048, len(ids), 2048)]
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.ids_crc32)
    assert got == want


def test_stages_keep_rows_and_columns(spark, tmp_path):
    table(spark, str(tmp_path))
    odd = [(None, None, "a", 1), (None, "", "b", 2), (7, "word " * 9, "c", 3), (7, "word " * 9, "c", 3), (8, "z" * 200_000, None, 4)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, document string, hits int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, str(tmp_path))
        assert got.columns == odd.columns and got.count() == 5, name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).select("doc_id").distinct().count() == 3
