"""Registered queries of the training-data operators: the contract's columns, derived from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kelvingrid.llm import bpe, chat, clustering, fingerprints, hyperminhash, merkle, mixing, ngram_join, quality, secrets, sharding, topk_search, url_filter
from kelvingrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes over all documents."""
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes they decode to, as digests."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ALLOW, BLOCK = ["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited twin, with their likeness."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


@query("op4_topk_search", TOPK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted, and what is read back from it."""
    planted = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.unionByName(extra)).drop("layout")


def domain() -> Column:
    """Domains of the mixing tree: the crowded source is a forum, the next nine are web sites, the rest is print."""
    return F.when(F.col("source") == "src0", "forum").when(F.col("source").rlike("^src[1-9]$"), "web").otherwise("print")


RECIPE = mixing.Recipe(domain={"forum": 1.0, "web": 2.0, "print": 3.0}, lang={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, share=0.8, max_epochs=3, seed=17)


def _water(children: str, parents: str, level: str, by: str, weight: str) -> str:
    """One level of budgeting: ``children`` has capacity, ``parents`` the budget of each family."""
    on = f"USING ({by})" if by else "ON true"
    part = f"PARTITION BY {by}" if by else ""
    return f"""
  SELECT * EXCLUDE (water, full_at, w, parent_budget), CASE WHEN water IS NULL THEN capacity ELSE least(capacity, greatest(0.0, w * water)) END AS budget FROM (
    SELECT * EXCLUDE (level), min(CASE WHEN capacity > w * level THEN {{'f': full_at, 'n': {level}, 'level': level}} END) OVER ({part}).level AS water FROM (
      SELECT *, (parent_budget - coalesce(sum(capacity) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM (SELECT c.*, p.parent_budget, {weight} AS w, capacity / {weight} AS full_at FROM {children} c JOIN {parents} p {on})))"""


MIXING_SQL = f"""
WITH counts AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'forum' WHEN regexp_matches(source, '^src[1-9]$') THEN 'web' ELSE 'print' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * 3 AS DOUBLE) AS capacity FROM counts GROUP BY ALL),
langs AS (SELECT domain, lang, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(capacity) AS capacity FROM langs GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * CAST(0.8 AS DOUBLE)) AS parent_budget FROM leaves),
d AS ({_water("domains", "root", "domain", "", "(CASE domain WHEN 'forum' THEN 1e0 WHEN 'web' THEN 2e0 ELSE 3e0 END)")}),
dp AS (SELECT domain, budget AS parent_budget FROM d),
l AS ({_water("langs", "dp", "lang", "domain", "(CASE lang WHEN 'en' THEN 4e0 WHEN 'de' THEN 2e0 WHEN 'fr' THEN 2e0 ELSE 1e0 END)")}),
lp AS (SELECT domain, lang, budget AS parent_budget FROM l),
s AS ({_water("leaves", "lp", "source", "domain, lang", "1e0")}),
b AS (SELECT domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS budget FROM s),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b),
o AS (SELECT c.*, e.epochs, e.budget - e.epochs * e.tokens AS rest, md5(concat('17:', e.epochs, ':', coalesce(CAST(c.doc_id AS VARCHAR), ''))) AS h
  FROM counts c JOIN e USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies FROM p
"""


@query("op10_mixing", MIXING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of 80 percent of all tokens takes each document, at most three times."""
    return mixing.mixture(table(spark, sf_dir, "documents"), domain(), RECIPE)


_COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {words} + 2), lambda i: array_to_string(ws[i:i + {words} - 1], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= {percent} * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id{more}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""


def _components_sql(words: int, percent: int, more: str = "") -> str:
    return _COMPONENTS_SQL.replace("{words}", str(words)).replace("{percent}", str(percent)).replace("{more}", more)


@query("op1_ngram_join", _components_sql(5, 75))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs of all nodes of the trees over ``leaves`` (grp, pos, h), the siblings' texts per level, and the tops."""
    nodes = [f"{name}0 AS MATERIALIZED (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS left_over FROM {leaves})"]
    for k in range(levels):
        nodes.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS left_over FROM (
              SELECT grp, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE left_over > 1 GROUP BY 1, 2))"""
        )
    run = "OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN"
    every = " UNION ALL ".join(
        f"""SELECT {k} AS level, grp, pos, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE left_over > 1"""
        for k in range(levels)
    )
    tops = " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE left_over = 1" for k in range(levels + 1))
    return [*nodes, f"{name}_sib AS MATERIALIZED ({every})", f"{name}_top AS MATERIALIZED ({tops})"]


def _fold_sql(name: str, source: str, levels: int, pos: str, grp: str, start: str) -> list[str]:
    """CTEs that fold the rows of ``source`` level by level; ``{name}{levels}`` has the folded digest and the siblings' text."""
    out = [f"{name}0 AS (SELECT *, {start} FROM {source})"]
    for k in range(levels):
        out.append(
            f"""{name}{k + 1} AS (SELECT t.* REPLACE (CASE WHEN s.l IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded, proof || coalesce(s.l || s.r, '') AS proof)
            FROM {name}{k} t LEFT JOIN {grp.split('.')[0]}_sib s ON s.level = {k} AND s.grp = t.{grp.split('.')[1]} AND s.pos = t.{pos} // {16**k})"""
        )
    return out


def _merkle_sql() -> str:
    fields = lambda text: " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, b: {bits}))"
    parts = [
        f"""lv AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS grp, sha256({fields('text')}) AS h,
          CASE WHEN coalesce({crc} % 5 = 0, FALSE) THEN sha256({fields(lower)}) END AS changed FROM documents)""",
        "lp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h, changed NULLS FIRST) - 1 AS pos FROM lv)",
        *_tree_sql("d", "lp", 6),
        "st AS MATERIALIZED (SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS pos FROM d_top)",
        *_tree_sql("s", "st", 4),
        *_fold_sql("f", "lp", 6, "pos", "d.grp", "coalesce(changed, h) AS folded, '' AS proof"),
        "mid AS (SELECT f6.doc_id, f6.h AS leaf, f6.folded AS f_in, f6.proof AS p_in, st.h AS subroot, st.pos AS spos, st.grp AS sgrp FROM f6 JOIN st ON st.name = f6.grp)",
        *_fold_sql("g", "mid", 4, "spos", "s.sgrp", "f_in AS folded, p_in AS proof"),
    ]
    final = "SELECT doc_id, leaf, subroot, s_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s_top.h AS verified FROM g4, s_top"
    return "WITH " + ",\n".join(parts) + "\n" + final


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root of the version that tampering makes."""
    found = merkle.lower_case_versions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _lloyd_sql() -> str:
    assign = lambda k: (
        f"""a{k} AS MATERIALIZED (SELECT row, vec_id, w, c AS cluster, d AS distance FROM (SELECT v.*, c.c, list_sum(list_transform(list_zip(v.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM v, c{k} c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)"""
    )
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, w) - 1 AS c, w FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, w FROM v ORDER BY h NULLS LAST, w LIMIT 16))""",
        assign(0),
    ]
    for k in range(3):
        parts += [
            f"""m{k} AS (SELECT cluster AS c, i, sum(w[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2)""",
            f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.w, o.w) AS w FROM c{k} o LEFT JOIN
              (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM m{k} GROUP BY 1) n ON n.c = o.c)""",
            assign(k + 1),
        ]
    final = """SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.w, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = a3.cluster"""
    return "WITH " + ",\n".join(parts) + "\n" + final


@query("op12_centroid_clusters", _lloyd_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all 64-component vectors after three rounds."""
    return clustering.cluster_report(table(spark, sf_dir, "embeddings")).drop("scanned")


@query("op13_hyperminhash_dedup", _components_sql(3, 85, ", d.doc_id = m.component_id AS kept"))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more, and which one of each stays."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")
