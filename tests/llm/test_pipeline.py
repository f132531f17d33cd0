"""The pipeline on documents with planted cases, each stage against brute force on its own input."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparkmetrica.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SYLLABLES = "ta re mi so lu ne va do ki pe ra to sa ni".split()


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 5))) for _ in range(n)]
    for k in range(0, n, 12):
        words[k] = words[k].capitalize()
        words[max(0, k - 1)] += "."
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    item = prose(rng, 30)
    passage = prose(rng, 60)
    rows = {i: prose(rng, int(rng.integers(40, 300))) for i in range(60)}
    rows |= {100: rows[7], 101: rows[7]}
    for k, i in enumerate((10, 11, 12)):
        rows[i] = prose(rng, 300)
        words = rows[i].split()
        words[150] = "altered"
        rows[110 + k] = " ".join(words)
    rows |= {120 + k: prose(rng, 80) + " " + passage + " " + prose(rng, 80) for k in range(4)}
    rows |= {130 + k: prose(rng, 100) + " " + item + " " + prose(rng, 50) for k in range(3)}
    rows |= {140 + k: " ".join(w + str(rng.choice(["###", "%%%", "$$$"])) for w in prose(rng, 80).split()) for k in range(8)}
    rows |= {150 + k: (prose(rng, 12).upper().replace(" ", "!! ") + " ") * 8 for k in range(8)}
    rows |= {160: None, 161: "", 162: prose(rng, 6000)}
    folder = str(tmp_path_factory.mktemp("planted"))
    table = [(i, t, "xx", "src", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


@pytest.fixture(scope="module")
def stages(spark, planted):
    folder, _, _ = planted
    docs, out = spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert [s.columns for s in stages[:4]] == [COLUMNS] * 4


def test_quality_stage(spark, planted, stages):
    folder, rows, _ = planted
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = texts(stages[0])
    assert kept == {i: t for i, t in rows.items() if model.judge(t)[1] >= 0.5}
    assert set(kept) == {i for i in rows if i < 140 or i == 162}


def test_near_duplicate_stage(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(before) - set(after) == {100, 101, 110, 111, 112} and all(after[i] == before[i] for i in after)


def test_repeat_stage(stages):
    before, after = texts(stages[1]), stages[2].collect()
    seen, want = set(), {}
    for i in sorted(before):
        data = before[i].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        want[i] = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode()
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert sum(len(before[i]) - len(want[i]) for i in (121, 122, 123)) > 900 and want[120] == before[120]


def test_benchmark_stage(planted, stages):
    _, _, item = planted

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    before, asked = texts(stages[2]), grams(item)
    hit = {i for i, t in before.items() if len(asked & grams(t)) >= 0.8 * len(asked)}
    assert 130 in hit and set(texts(stages[3])) == set(before) - hit


def test_packing_stage(stages):
    filled, pieces = defaultdict(list), defaultdict(int)
    for r in stages[4].collect():
        filled[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    for places in filled.values():
        assert sum(n for _, n in places) <= 2048 and [p for p, _ in sorted(places)] == [sum(n for q, n in places if q < p) for p, _ in sorted(places)]
    assert set(pieces) == set(texts(stages[3])) and len(filled) <= sum(pieces.values()) // 2048 + 2


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_a_stage_sends_batches_of_about_a_megabyte(spark, planted, stage):
    """A batch is held several times outside the heap, and what five stages leave behind adds up."""
    stage(spark, spark.read.parquet(f"{planted[0]}/documents.parquet").select(*COLUMNS), planted[0])
    texts = spark.range(400, numPartitions=1).selectExpr("repeat(char(97 + id % 26), 20000) AS text")
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 8_000_000 and max(r.n for r in sizes) < 1.2 * (1 << 20)


def test_run_gives_the_last_stage(spark, planted, stages):
    got = corpus_pipeline.run(spark, planted[0])
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[4].select(*key).collect()))
