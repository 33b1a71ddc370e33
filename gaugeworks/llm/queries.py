"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, centroids, decontaminate, divergence, fingerprints, minhash, pieces, pii, quality, rans, secrets, substring, urls
from gaugeworks.llm.common import materialise, table


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A key for tests and benchmarks; a corpus that is published has a secret one.
PII_KEY = "gaugeworks"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    replaced = pii.replace_pii(docs, PII_KEY)
    kinds = F.array_join(F.transform("found", lambda e: F.concat_ws(":", e.kind, e.text)), ",")
    return replaced.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), kinds.alias("surrogates"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep_text=False)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", F.inline("hits")).select("doc_id", "item_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "distance")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = rans.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rans.read_blocks(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that loses text: what stays of it, where that stood, and what went for which earlier document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = materialise(substring.repeated_spans(docs), "spans")
    return substring.remove_spans(docs, spans, changed=True).select("doc_id", "text", "kept", "spans", "n_spans", "n_words")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs)
    base = F.array(*(F.lit(r.kind) for r in secrets.BASE_RULES))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE_RULES),
        F.sha2(text(F.filter("found", lambda s: F.array_contains(base, s.kind))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.piece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.crc32("offsets").alias("offsets_crc32"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _listed_sql(rule: urls.UrlRule) -> str:
    host, _, path = rule.name.partition("/")
    return f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}') then '{rule.name}'"


OP10_SQL = f"""
with parts as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages
), judged as (
  select page_id, host, path, case {" ".join(_listed_sql(r) for r in sorted(urls.LISTED_RULES, key=lambda r: -len(r.name)))} end as rule from parts
)
select page_id, host, path, rule,
       case when rule in ({", ".join(f"'{r.name}'" for r in urls.LISTED_RULES if r.verdict == "block")}) then 'block'
            when rule is not null then 'allow'
            when {" or ".join(f"regexp_matches(host || path, '{r.regex}')" for r in urls.PATTERN_RULES if r.verdict == "block")} then 'block'
            else 'allow' end as verdict
from judged
"""


OP12_SQL = f"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), counts as (
  select lang, source, term, count(*) as n, count(distinct r) as d from (select r, lang, source, unnest(terms) as term from docs) group by all
), kept as (
  select lang, term, sum(n)::hugeint as n from counts group by all having sum(d) >= {divergence.LEAST_DOCUMENTS}
), langs as (
  select lang, count(*) as v, sum(n) as whole from kept group by all
), groups as (
  select distinct lang, source from docs
), sizes as (
  select lang, source, sum(c.n)::hugeint as whole from counts c semi join kept using (lang, term) group by all
), grid as (
  select lang, source, term, coalesce(c.n, 0) as n, 1 + {divergence.UNIT}::hugeint * (coalesce(c.n, 0) + {divergence.ADDED}) // (coalesce(s.whole, 0) + {divergence.ADDED} * v) as p,
         1 + {divergence.UNIT}::hugeint * (kept.n + {divergence.ADDED}) // (langs.whole + {divergence.ADDED} * v) as q
  from groups join kept using (lang) join langs using (lang) left join counts c using (lang, source, term) left join sizes s using (lang, source)
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source != b.source group by all
), every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source != b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, (p - q)::bigint from grid where n > 0 and p > q
)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from every qualify part = 'pair' or rank <= {divergence.TOP}
"""


def _clusters_sql(rounds: int, clusters: int) -> str:
    """Each round's assignment by all distances, and its centroids, which are (cluster, list of components)."""
    nearest = """select vec_id, v, c.cluster, list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance
      from kept cross join {0} c qualify row_number() over (partition by vec_id order by distance, c.cluster) = 1"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} as ({nearest.format(f'c{k}')})")
        if k < rounds:
            steps.append(f"""s{k} as (select cluster, pos, sum(x)::hugeint as s, count(*)::hugeint as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as pos from a{k}) group by all),
  c{k + 1} as (select cluster, coalesce(m, c) as c from c{k} left join (select cluster, list(((s - (s % n + n) % n) // n)::bigint order by pos) as m from s{k} group by cluster) using (cluster))""")
    return f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v as c from kept qualify cluster < {clusters}
), {", ".join(steps)}
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)
"""


OP13_SQL = _clusters_sql(centroids.ROUNDS, centroids.CLUSTERS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filter": op10_url_filter,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": OP10_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
