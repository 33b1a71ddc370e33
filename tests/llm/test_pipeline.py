"""The pipeline's stages, each against what it promises."""

import base64
import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import components, nearest, prose, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_columns_and_lose_rows_only(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == stages[0].columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        assert 0 < after.count() <= before.count()
    assert stages[5].count() == stages[4].count() == stages[3].count()


def test_rejected_documents_are_mostly_bad(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.join(stages[1], "doc_id").agg(F.avg("quality")).first()[0]
    assert kept > 0.95


def test_no_benchmark_item_stays(stages, spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [t for (t,) in stages[3].select("text").collect() if any(i in t for i in items)]


def test_tokens_decode_to_the_text(stages):
    want = {r.doc_id: r.d for r in stages[4].select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert {r.doc_id: r.text_sha256 for r in stages[5].collect()} == want


# ---- against a brute-force pipeline, on rows of every awkward kind ------------------------------------------------

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _quality string, hits string, found string, kept string, row string"
ITEM = prose(14, 900)
GOOD = [prose(40, 1000 + k) for k in range(60)]
BAD = [prose(6, 2000 + k).upper() + " !!! $$$" * 20 for k in range(60)]
MAIL = "jo.doe@mail.example.com"
EDITED = GOOD[1].split()
EDITED[20] = "other"
ROWS = [
    *((k, t) for k, t in enumerate(GOOD)), *((100 + k, t) for k, t in enumerate(BAD)), (200, GOOD[0]), (201, " ".join(EDITED)), (202, GOOD[2] + " " + ITEM), (203, GOOD[3][:200] + " " + ITEM.replace("a", "", 1)),
    (204, prose(40, 3000) + f" {MAIL}"), (205, prose(40, 3001) + f" {MAIL} and {MAIL}."), (206, None), (207, ""), (208, prose(45, 3002)), (208, prose(45, 3002)), (208, prose(45, 3003)), (None, prose(45, 3004)), (None, prose(45, 3004)), (None, None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "q", "h", "f", "k", "r") for i, t in ROWS], COLUMNS)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_a_brute_force_pipeline(spark, folder):
    import tiktoken

    rows = [r for r in ROWS if r[1] not in BAD]  # the classifier's share of this fixture's good labels is a half
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    comp = components({k: shingles(t or "") for k, (_, t) in enumerate(rows)})
    rows = [r for k, r in enumerate(rows) if comp[k] == k]
    rows = [(i, t) for i, t in rows if not t or nearest(ITEM, t) > len(ITEM) // 16]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoded = {}
    for r in got:
        text = library.decode_bytes([int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]).decode()
        assert r.n_tokens * 4 == len(r.ids) and library.encode_ordinary(text) == [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        decoded.setdefault(r.doc_id, []).append(text)
    mails = set()
    for i, t in rows:
        if t and MAIL in t:
            m = re.fullmatch(re.escape(t).replace(re.escape(MAIL), r"(\S+@\S+\.example\.(?:com|net|org))"), decoded[i][0])
            mails |= set(m.groups())
        else:
            assert (t or "") in decoded[i]
    assert len(mails) == 1 and MAIL not in mails


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_rows(spark, folder, k):
    """Each stage on all rows at once, on none, and with columns whose names clash."""
    docs, (_, stage) = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.STAGES[k]
    out, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
    assert none.count() == 0
    if k == 4:
        assert out.count() == len(ROWS)
        return
    assert out.columns == docs.columns and out.schema == none.schema
    got = out.collect()
    assert {(r["_quality"], r.hits, r.found, r.kept, r.row) for r in got} == {("q", "h", "f", "k", "r")}
    sizes = {0: len(ROWS) - len(BAD), 2: len(ROWS) - 2, 3: len(ROWS)}
    assert len(got) == sizes.get(k, len(got))
    if k == 1:
        texts = [r.text for r in got if r.text]
        assert len(texts) == len(set(texts)) and sum(not r.text for r in got) == 3
        assert {r.doc_id for r in got if r.doc_id is not None} == {i for i, _ in ROWS if i is not None} - {200, 201}
    if k == 3:
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_a_stage_that_is_given_no_labels_or_items(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == len(ROWS)
