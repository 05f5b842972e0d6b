"""Extra columns of any name, odd label types and very long texts in the operators and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from turnloom.llm import jaccard, language, lines, quality, toxicity

NAMES = ["__id2", "__text", "__id", "__node", "__n", "__n_words", "__lang", "__score", "a.b", "c0", "q", "__least", "__keep", "n_words", "component_id", "__group", "x y`z"]
LINE = " ".join(f"w{i}" for i in range(60))
TEXTS = ["The cat sat on the mat and saw ten birds.\n" + LINE, "A dog ran over the long hill today and slept.\n" + LINE, None, "", "The cat sat on the mat and saw ten birds.\n" + LINE]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 9, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    quoted = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long"] + [f"c{i} string" for i in range(len(NAMES))])
    return spark.createDataFrame(rows, quoted).toDF("doc_id", "text", "lang", "source", "n_chars", *NAMES)


def extras(df):
    """{doc_id: the other columns as they were}."""
    at = [df.columns.index(n) for n in NAMES]
    return {r[df.columns.index("doc_id")]: [r[i] for i in at] for r in df.collect()}


def as_before(df, ids):
    got = extras(df)
    assert got == {i: [f"{n}{i}" for n in NAMES] for i in ids}


def test_operators_carry_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    as_before(lines.without_repeats(docs), range(5))
    as_before(jaccard.one_of_each(docs), [0, 1, 2, 3])
    kept = [n for n in docs.columns if not n.startswith("__")]
    judged = quality.judge(docs, labels, kept)
    assert {r["doc_id"]: r["a.b"] for r in judged.collect()} == {i: f"a.b{i}" for i in range(5)} and "__kept" in judged.columns
    names, vectors = language.prototypes(docs)
    named = language.identify(docs, names, vectors, docs.columns)
    assert named.columns.count("__lang") == 1 and {r["doc_id"]: r["__lang"] for r in named.collect()} == {0: "en", 1: "en", 2: "und", 3: "und", 4: "en"}
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, docs.columns)
    assert scored.columns.count("__score") == 1 and scored.filter("c0 is null").count() == 0


def test_stages_return_the_columns_of_documents(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        as_before(out, ids)


@pytest.mark.parametrize("kind", ["bigint", "double", "boolean", "string"])
def test_labels_of_any_type(spark, docs, kind):
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int").withColumn("toxic", F.col("toxic").cast(kind))
    assert toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).count() == 5


def test_a_hundred_thousand_lines_in_one_text(spark):
    """Short lines with a run of 30 lines that comes twice, and a line that stands alone."""
    own = [f"line number {i} is short" for i in range(100_000)]
    text = "\n".join(own[:90_000] + own[500:530] + own[90_000:])
    rows = spark.createDataFrame([(1, text), (2, "before\n" + "\n".join(own[70_000:70_040])), (3, own[5])], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["__removed"]) for r in lines.without_repeats(rows).collect()}
    assert got == {1: ("\n".join(own), 30), 2: ("before", 40), 3: (own[5], 0)}


def test_profiles_do_not_depend_on_the_slices(monkeypatch):
    """A text of 20,000 different n-grams, in one slice and in many."""
    import random

    import pyarrow as pa

    from turnloom.llm.arrays import Block

    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), "short one", None, "", "Ünder the bridge"] * 2
    block = Block(pa.RecordBatch.from_pydict({"text": pa.array(texts)}))
    monkeypatch.setattr(language, "KINDS", 1 << 30)
    whole, letters = language.bundles(block, 64, 3)
    for size in (1, 7, 4096):
        monkeypatch.setattr(language, "KINDS", size if size > 1 else 20_001)
        part, again = language.bundles(block, 64, 3)
        assert (part == whole).all() and (again == letters).all()
