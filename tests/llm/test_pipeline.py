import re

import corpus_pipeline
import public_tokenizers as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ballotbox.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    good = steps["quality"](spark, docs, SF)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, quality.trained(docs, labels)).collect() if r.predicted == 1}
    civil = steps["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in civil.collect()} == {r.doc_id for r in toxicity.score(docs, toxicity.trained(docs, labels)).collect() if r.predicted == 0}

    best = {}
    for r in docs.collect():
        k = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        best[k] = min(best.get(k, (1, 0)), (-len(r.text or ""), r.doc_id))
    distinct = steps["exact dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(i for _, i in best.values()) and distinct.columns == columns

    rows = [(r.doc_id, r.text) for r in distinct.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    unlike = steps["n-gram join"](spark, distinct, SF)
    assert {r.doc_id for r in unlike.collect()} == {find(i) for i in sets} and unlike.columns == columns

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = sum(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in unlike.collect())
    assert sum(p.length for p in steps["packing"](spark, unlike, SF).collect()) == tokens


#: Columns that the operators use inside too.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted int, score double, held_out boolean, h1 long, digest string, key string, node long, kind int, part int, `__keep` int"
LONG = " ".join(f"word{i}" for i in range(30))


def rows_of(spark, some):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 0.0, None, 1, "d", "k", k, 0, 0, 3) for k, (i, t) in enumerate(some)], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


ODD = [(1, LONG), (5, LONG), (5, "quite another text of its own"), (5, "quite another text of its own"), (None, "no id"), (None, None), (7, ""), (8, None), (8, "a"), (9, LONG + " x"), (None, LONG), (10, "z" * 300_000)]


def test_stages_on_odd_rows(spark):
    steps, df = dict(corpus_pipeline.STAGES), rows_of(spark, ODD).repartition(3)
    for name in ("quality", "toxicity"):
        got = steps[name](spark, df, SF)
        assert got.columns == df.columns and set(kept(got)) <= set(ODD) and got.schema == df.schema
        assert steps[name](spark, df.limit(0), SF).count() == 0

    got = steps["exact dedup"](spark, df, SF)
    assert got.columns == df.columns
    assert kept(got) == kept(rows_of(spark, [(1, LONG), (5, "quite another text of its own"), (None, "no id"), (7, ""), (8, "a"), (9, LONG + " x"), (10, "z" * 300_000)]))
    assert steps["exact dedup"](spark, df.limit(0), SF).count() == 0

    got = steps["n-gram join"](spark, df, SF)
    assert got.columns == df.columns
    wordless = [(None, None), (7, ""), (8, None)]
    assert kept(got) == kept(rows_of(spark, [(1, LONG), (5, "quite another text of its own"), (None, "no id"), (8, "a"), (10, "z" * 300_000), *wordless]))
    assert steps["n-gram join"](spark, df.limit(0), SF).count() == 0

    assert steps["packing"](spark, df, SF).filter("start = 0").count() == len(ODD)
    assert steps["packing"](spark, df.limit(0), SF).count() == 0


def test_near_duplicates_by_id_and_text(spark):
    """Unrelated documents that share an id stay; of rows that are equal in both, and of null ids, one of a group stays."""
    other = " ".join(f"other{i}" for i in range(30))
    some = [(1, LONG), (5, LONG), (5, other), (1, LONG), (None, other + " y"), (None, "alone " + LONG[:40]), (6, other + " z")]
    got = corpus_pipeline.unlike(spark, rows_of(spark, some), SF)
    assert kept(got) == kept(rows_of(spark, [(1, LONG), (5, other), (None, "alone " + LONG[:40])]))


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    made = corpus_pipeline.run(spark, SF).collect()
    assert made and sum(r.length for r in docs.collect()) == sum(r.length for r in made)
    assert {r.doc_id for r in docs.select(*key).collect()} == {r.doc_id for r in made}


def test_memory_of_a_stage_is_bounded(spark, tmp_path):
    """A task holds one row group and one decoded batch at once: neither grows with what it reads and writes (46 MB here, in one task)."""
    names = ("spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size")
    for name in names:
        spark.conf.unset(name)
    text = F.concat(*[F.sha2((F.col("doc_id") * 1000 + i).cast("string"), 256) for i in range(180)])
    docs = spark.range(0, 4000, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", text)
    out = corpus_pipeline.distinct(spark, docs, SF)
    out.write.parquet(str(tmp_path / "out"))
    groups = [m.row_group(i) for f in (tmp_path / "out").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4000
    assert max(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups) < 24 << 20
    assert int(spark.conf.get(names[0])) <= 512

    for name in names:
        spark.conf.set(name, "100")
    corpus_pipeline.small_batches(spark)
    assert [spark.conf.get(name) for name in names] == ["100", "100"]
    for name in names:
        spark.conf.unset(name)
