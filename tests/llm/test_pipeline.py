"""The pipeline's stages on a small table, each against a plain check, and the registered SQL."""

import random
import tempfile

import duckdb
import pytest

pytest.importorskip("corpus_pipeline")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from quoteloom.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        kept[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == columns
    before, after = kept["near_duplicates"]
    # the stage's rule is a similarity of 0.8 on five-word shingles, so that is what is looked at
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in before.collect()}
    known = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    alike = lambda a, b: len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b])
    left = {r.doc_id for r in after.collect()}
    for a in known:
        if a not in left:
            assert any(alike(a, b) for b in known if b != a)
    assert not any(a < b and alike(a, b) for a in left for b in left)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = kept["decontamination"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone == {r.doc_id for r in before.collect() if any(i in " ".join(r.text.split()) for i in items)}
    mixed = kept["mixing"][1].collect()
    assert mixed and all(len(r.text.split()) == r.taken for r in mixed)


def test_near_copies_are_one_document(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(60):  # pairs at 0.89 and about 0.8
        words = prose(88)
        texts += [words, ["x" if i == 40 else w for i, w in enumerate(words)]]
        texts += [(words := prose(100)), ["x" if i in (30, 70) else w for i, w in enumerate(words)]]
    crowd = prose(200)
    texts += [[f"c{k}" if i == 3 * k else w for i, w in enumerate(crowd)] for k in range(60)]
    texts += [crowd[:100] + prose(100), crowd[:60], prose(3)]

    def sets(words):
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    known = [sets(w) for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(known[i] & known[j]) >= 0.8 * len(known[i] | known[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert left == set(root) and len(left) == 124


def test_rows_without_a_doc_id_and_odd_columns(spark):
    """Rows that share a doc_id or have none are documents; names and types of other columns do not matter."""
    rows = [(None, "one text of its own here", {"k": 1}), (None, "another text of its own", {"k": 2}), (3, "one text of its own here", {"k": 3}), (4, "x", {}), (4, "y", {}), (4, "y", {})]
    names = "doc_id long, text string, size map<string,int>"
    docs = spark.createDataFrame(rows, names).selectExpr("doc_id", "text", "size", "'en' AS lang", "'s' AS source", "1L AS n_chars", *(f"7 AS `{c}`" for c in ("a.b", "taken", "copy", "finish", "target", "score", "predicted", "n_lines", "n_dropped", "_host", "_lines", "component_id", "row")))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() >= 1
        if name != "mixing":
            assert got.columns == docs.columns and {r["a.b"] for r in got.select("`a.b`").collect()} == {7}
        if name == "near_duplicates":
            assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", "one text of its own here"), ("4", "x"), ("4", "y"), ("None", "another text of its own")]


def test_empty_tables(spark):
    """Every stage of an empty table, and the first and fourth with nothing to learn or look for."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    none = {name: spark.read.parquet(f"{SF}/{name}.parquet").limit(0) for name in ("labels", "benchmark")}
    bare = tempfile.mkdtemp()
    for name, table in none.items():
        table.write.parquet(f"{bare}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, bare).count() == docs.count() == stages["decontamination"](spark, docs, bare).count()


def test_copies_keep_their_lines(spark):
    prose = lambda k: "\n".join(f"line {k} {j}" for j in range(4))
    texts = [prose(k) + ("\nfooter" if k < 20 else "") for k in range(40)] + [prose("copied")] * 30 + [prose("few")] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {i: t.removesuffix("\nfooter") for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_stages_leave_only_their_last_tables(spark, tmp_path):
    """A stage's own tables go when the next one begins, but not while its result reads them."""
    import os

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = lambda: set(os.listdir(shared.removeprefix("file:")))
    (_, first), (_, second), (_, third) = corpus_pipeline.STAGES[:3]
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = folder()
    second(spark, docs, SF).write.parquet(f"{tmp_path}/lines")
    lines = folder() - before
    third(spark, spark.read.parquet(f"{tmp_path}/lines"), SF).write.parquet(f"{tmp_path}/near")
    assert not lines & folder()
    lazy = second(spark, docs, SF)
    lazy = third(spark, lazy, SF)
    assert lazy.count() == spark.read.parquet(f"{tmp_path}/near").count()


def test_links_across_components_in_blocks(spark, monkeypatch):
    """However a crowded key is dealt, the components are those of all pairs."""
    from quoteloom.llm import near_copies

    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(90):  # a drift: neighbours are near copies, the ends are not
        base = ["v%d" % rng.randrange(10**6) if i == (7 * k) % 120 else w for i, w in enumerate(base)]
        texts.append(list(base))
    known = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b]):
                root = [root[b] if r == root[a] else r for r in root]
    want = {frozenset(k for k, r in enumerate(root) if r == s) for s in set(root)}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    for block in (4096, 7):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "CROWD", 2)
        got = near_copies.near_copies(docs).collect()
        assert {frozenset(r.doc_id for r in got if r.component_id == c) for c in {r.component_id for r in got}} == want
