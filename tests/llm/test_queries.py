"""The registered queries over small tables of awkward rows, each column of each contract against brute force."""

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gaugeworks.llm import queries, secrets
from tests.llm.test_operators import TEXTS, canonical, components, prose, shingles

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "((?ai:password").replace("key)", "key))", 1))
ALL = [*TEXTS, "ﬁne TEXT", "Fine text", "line of nine words that stands in two documents\nown words", "other words\nline of nine words that stands in two documents", 'Secret: "aaaabbbbccccdddd" passwd=short api-key=no APIKEY = x1x1x1x1x1x1', "AKIA" + "Z" * 14 + " AKIAABC " + "0123456789abcdef" * 2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    ids = [k * 3 + 1 for k in range(len(ALL))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in zip(ids, ALL, strict=True)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(k % 3 > 0), 0) for k, i in enumerate(ids)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(TEXTS[12].split()[5:25])), (2, prose(25, 777)), (3, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://Foo.NET", "https://a.example.net/en/x?q#f", "https://example.net/EN/", "ftp://b.example.com/de/1", "http://x.org/fr/", "http://spam-farm.example.org/", "http://a.io/wp-login.php", "http://a.io/x-spam/", "http://q.io/download/a.zip", "http://porn.io", "http://aporn.io"]
    spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls * 2)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors = [(k, [((k * 7 + d * 3) % 11 - 5) / 8 for d in range(64)], k % 3) for k in range(40)] + [(90, None, 1), (91, [0.5], 1)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def own():
    return {k * 3 + 1: t or "" for k, t in enumerate(ALL)}


def run(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, sf, own):
    got, ids = run(spark, sf, "op1_document_fingerprints"), sorted(own)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        n = len(own[i]) // 4
        edited = own[i][: len(own[i]) - n] + own[j][:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own[i]), sha(edited.encode()))
        assert (r.near_edited, r.near_next) == (canonical(own[i]) == canonical(edited), canonical(own[i]) == canonical(own[j]))
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert all((got[i].fingerprint == got[j].fingerprint) == (canonical(own[i]) == canonical(own[j])) for i in ids for j in ids)


def test_op2(spark, sf, own):
    """What goes was there before, what stays is the original's, and no whole line stays twice."""
    got = run(spark, sf, "op2_substring_dedup")
    kept = {i: "".join(t[s.start : s.end] for s in got[i].kept) if i in got else t for i, t in own.items()}
    seen = set()
    for i in sorted(own):
        if i in got:
            assert got[i].text == kept[i] and got[i].n_spans == len(got[i].spans) > 0
            assert all(0 <= s.start_at < s.end_at <= len(own[i]) and (s.first_doc_id, s.first_start) < (i, s.start_at) for s in got[i].spans)
            assert got[i].n_words == sum(len(re.findall(r"[^ \t-\r]+", own[i][s.start_at : s.end_at])) for s in got[i].spans)
        lines = [tuple(x.split()) for x in kept[i].split("\n") if x.split()]
        whole = {tuple(x.split()) for x in own[i].split("\n")}
        assert not [x for x in lines if x in seen and x in whole]
        seen |= whole
    assert 22 in got and not kept[22]  # a copy


def test_op3(spark, sf, own):
    got = run(spark, sf, "op3_secret_scan")
    for i, t in own.items():
        base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        order = ["assign", "access", "hex"]
        base.sort(key=lambda s: (s[1], order.index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in order)
        assert r.base_sha256 == sha(text.encode())
        kinds = [x.kind for x in secrets.BASE_RULES + secrets.MORE_RULES]
        more = [(x.kind, m.start(), m.end()) for x in secrets.MORE_RULES for m in re.finditer(x.pattern, t)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base + more, key=lambda s: (s[1], kinds.index(s[0]))))
    assert sum(r.n_assign for r in got.values()) >= 5


def test_op4(spark, sf, own):
    got, sets = run(spark, sf, "op4_minhash_near_dedup"), {i: shingles(t) for i, t in own.items()}
    comp = components(sets)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in own}


def test_op5(spark, sf, own):
    got = run(spark, sf, "op5_pii_surrogates")
    changed = {i for i, t in own.items() if (got[i].text or "") != t}
    assert changed == {i for i, r in got.items() if r.n_replaced} == {i for i, t in own.items() if "@mail" in t}
    assert all(r.surrogates.count(":") >= r.n_replaced for r in got.values())


def test_op6(spark, sf, own):
    got = run(spark, sf, "op6_quality_classifier")
    assert set(got) == set(own)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert len({got[i].score for i, t in own.items() if not t}) == 1


def test_op7(spark, sf, own):
    rows = queries.QUERIES["op7_decontamination"](spark, sf).collect()
    found = [(r.doc_id, r.item_id) for r in rows]
    assert found == [(37, 1)] and rows[0].distance == 0 and own[37][rows[0].start_at : rows[0].end_at] == " ".join(TEXTS[12].split()[5:25])


def test_op8(spark, sf, own):
    from tokenizers import Tokenizer

    got, tokenizer, start = run(spark, sf, "op8_token_files"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i in sorted(own):
        ids = np.array([*tokenizer.encode(own[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9(spark, sf, own):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in run(spark, sf, "op9_byte_bpe").items():
        ids = library.encode_ordinary(own[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own[i].encode()))


def test_op10(spark, sf):
    got = run(spark, sf, "op10_url_filter")
    sql = queries.ORACLE_SQL["op10_url_filter"].replace("from pages", f"from '{sf}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in got.values()} == set(duckdb.sql(sql).fetchall())
    verdicts = [got[k].verdict for k in range(14)]
    assert verdicts == ["allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block", "allow", "block", "block", "allow"]


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_centroid_clusters"])
def test_queries_that_sql_expresses(spark, sf, name):
    tables = {t: f"'{sf}/{t}.parquet/*.parquet'" for t in ("documents", "embeddings")}
    sql = queries.ORACLE_SQL[name]
    for t, place in tables.items():
        sql = re.sub(rf"from {t}\b", f"from {place}", sql)
    got, want = queries.QUERIES[name](spark, sf), duckdb.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert len(rows) == len(set(rows)) > 0 and set(rows) == set(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for table in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
