"""Every query of the subpackage on the smallest tables, against its SQL where it has one; the pipeline's stages."""

import itertools
import re
import uuid
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from fenloom.llm import mixing
from fenloom.llm.queries import QUERIES, SQL
from fenloom.session import cut_lineage, shared_dir
from tests.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    rows = {"op3_html_text": "pages", "op10_near_vectors": "embeddings"}.get(name, "documents")
    if name not in ("op11_collocations", "op13_best_fit_packing"):  # a row a phrase or a piece
        assert len(got) == spark.read.parquet(f"{SF}/{rows}.parquet").count()
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        problem = compare(got, con.execute(SQL[name]).df())
        assert problem is None, problem


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
    assert corpus_pipeline.mixed_sources(spark, docs, SF).count() > 0


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.filter("NOT lossless OR n_tokens = 0").count() == 0


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count() and (name == "pieces" or out.columns == docs.columns), name


def shingles_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return Counter(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def near_kept(texts):
    """Ids that stay when texts of similarity 0.8 or more are linked: every pair compared."""
    sets, root = {i: shingles_of(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        both = sum((x & y).values())
        if both and 10 * both >= 8 * (x.total() + y.total() - both):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i for i in texts if root[i] == i}


def test_each_stage_keeps_what_plain_python_keeps(spark):
    """Planted exact and near copies and texts of an unknown language among the smallest documents."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    top = max(r["doc_id"] for r in rows) + 1
    long = [r for r in rows if len((r["text"] or "").split()) >= 60][:12]
    planted = []
    for k, r in enumerate(long):
        words = r["text"].split()
        planted.append(r | {"doc_id": top + 10 * k, "text": "\n\t".join(r["text"].split(" "))})
        planted.append(r | {"doc_id": top + 10 * k + 1, "text": " ".join(words[:-1] + ["changed"])})
        planted.append(r | {"doc_id": top + 10 * k + 2, "text": " ".join(words[len(words) // 2:])})  # too far to be a copy
        planted.append(r | {"doc_id": top + 10 * k + 3, "lang": None, "text": f"съешь же ещё этих мягких булок {k} да выпей чаю " * 8})
    foreign = {r["doc_id"] for r in planted if "булок" in r["text"]}
    docs = spark.createDataFrame(rows + planted, spark.read.parquet(f"{SF}/documents.parquet").schema)
    text = {r["doc_id"]: r["text"] or "" for r in rows + planted}
    stages, folder = dict(corpus_pipeline.STAGES), shared_dir(spark)

    def after(name, docs):
        path = f"{folder}/kept-{uuid.uuid4().hex}"
        stages[name](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    docs = after("language", docs)
    kept = [r.doc_id for r in docs.collect()]
    want = {i for i, t in text.items() if i not in foreign and any(c.isalpha() for c in t)}
    assert sorted(kept) == sorted(want)
    docs = after("exact dedup", docs)
    first = {}
    for i in sorted(want):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(kept) == sorted(first.values()) and len(first) <= len(want) - len(long)
    docs = after("near dedup", docs)
    want = near_kept({i: text[i] for i in first.values()})
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(kept) == sorted(want) and len(want) <= len(first) - len(long)
    sizes = mixing.sized(docs, "doc_id", "source", "text")
    taken = {r.id: r.taken for r in mixing.Mix(cut_lineage(sizes.drop("row"))).rows.collect()}
    docs = after("mixing", docs)
    words = Counter()
    for r in docs.collect():
        got, whole = r.text.split(), text[r.doc_id].split()
        assert len(got) <= len(whole) and not Counter(got) - Counter(whole)
        words[r.doc_id] += len(got)
    assert {i: n for i, n in taken.items() if n} == dict(words)
    assert all(n <= 2 * len(text[i].split()) for i, n in words.items())
    mixed = Counter((r.doc_id, r.text) for r in docs.collect())
    got = after("pieces", docs).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.lossless and r.n_tokens == len(r.ids) and max(r.ids) < model.get_piece_size() for r in got)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in mixed.elements())


def test_mixing_runs_no_python(spark, monkeypatch):
    """Neither in its plan nor as a job of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def refused(*args):
        raise AssertionError("a Python job")

    monkeypatch.setattr(corpus_pipeline, "return_memory", refused)
    out = corpus_pipeline.mixed_sources(spark, docs, SF)
    assert out.count() > 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
