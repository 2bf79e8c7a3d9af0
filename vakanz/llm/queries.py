"""One query per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vakanz.llm import (
    best_fit, chat, exact_dedup, hnsw, merkle, mixing, near_dup, quality_model, quality_rules, token_blocks,
    toxicity, url_filter, whitening,
)
from vakanz.llm.common import stage, table
from vakanz.llm.labelled import fold_of
from vakanz.llm.registry import QUERIES, SQL, query  # noqa: F401

# Fixed values of the URL query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"))

OP1_SQL = f"""
WITH rules(rule, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
r AS (SELECT rule, action, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp
      FROM rules),
p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END
      AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS hr FROM p),
q AS (SELECT page_id, translate(hr, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             regexp_extract(substr(rest, length(hr) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT page_id, host, path, (SELECT max({{'n': length(rule), 'h': length(rh), 'rule': rule, 'action': action}})
      FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM q)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM f
"""


@query("op1_url_filter", OP1_SQL)
def op1(spark, sf_dir):
    rules = spark.createDataFrame(list(RULES), "rule string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


@query("op7_mixing")
def op7(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(*mixed).select("doc_id", "size", "source_size", "target", "taken", "source")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
g AS (SELECT sha, count(*) AS n, max({'c': length(text), 'i': -doc_id}) AS best FROM d GROUP BY sha)
SELECT doc_id, -best.i AS keep_id, n AS group_size, doc_id = -best.i AS kept, sha AS text_sha256
FROM d JOIN g USING (sha)
"""


@query("op8_exact_dedup", OP8_SQL)
def op8(spark, sf_dir):
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), trusted)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "ratio")


@query("op3_token_blocks")
def op3(spark, sf_dir):
    import public_tokenizers

    return token_blocks.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op5_chat_format")
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digests(stage(chat.format_windows(rows.unionByName(extra))))


@query("op4_toxicity")
def op4(spark, sf_dir):
    known = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), known)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_quality_model")
def op2(spark, sf_dir):
    known = table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 4) != 2)
    scored = quality_model.score_quality(table(spark, sf_dir, "documents"), known)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_near_dup")
def op9(spark, sf_dir):
    return near_dup.near_components(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op6_best_fit")
def op6(spark, sf_dir):
    # equal texts are one duplicate cluster
    return best_fit.pack(table(spark, sf_dir, "documents"), cluster=exact_dedup.content_of(F.col("text")))


# Every level is a recursion step over both trees; the CRC-32 is folded bit by bit.
OP13_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(
    [xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
hashed AS (SELECT doc_id, source, {leaf} AS leaf,
    sha256({fields} || {changed}) AS other FROM docs),
base AS (SELECT row_number() OVER () AS rid, doc_id, source, leaf, other, coalesce('n' || source, '-') AS grp,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS size FROM hashed),
nodes AS (SELECT 0 AS lvl, grp, idx, size, leaf AS hash FROM base UNION ALL
  SELECT lvl + 1, grp, idx // 16, (max(size) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE size > 1 GROUP BY lvl, grp, idx // 16),
tops AS (SELECT n.lvl AS height, n.grp, n.hash, row_number() OVER (ORDER BY b.source NULLS FIRST) - 1 AS idx,
    count(*) OVER () AS size
  FROM nodes n JOIN (SELECT DISTINCT grp, source FROM base) b USING (grp) WHERE n.size = 1),
upper AS (SELECT 0 AS lvl, idx, size, hash FROM tops UNION ALL
  SELECT lvl + 1, idx // 16, (max(size) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM upper WHERE size > 1 GROUP BY lvl, idx // 16),
root AS (SELECT hash FROM upper WHERE size = 1),
beside AS (
  SELECT b.rid, n.lvl AS step, n.idx, n.hash, n.idx < b.idx // (16 ** n.lvl)::BIGINT AS left_of
  FROM base b JOIN nodes n ON n.grp = b.grp AND n.size > 1 AND n.idx // 16 = b.idx // (16 ** (n.lvl + 1))::BIGINT
    AND n.idx <> b.idx // (16 ** n.lvl)::BIGINT
  UNION ALL
  SELECT b.rid, t.height + u.lvl, u.idx, u.hash, u.idx < t.idx // (16 ** u.lvl)::BIGINT
  FROM base b JOIN tops t USING (grp) JOIN upper u ON u.size > 1
    AND u.idx // 16 = t.idx // (16 ** (u.lvl + 1))::BIGINT AND u.idx <> t.idx // (16 ** u.lvl)::BIGINT),
proofs AS (SELECT rid, sha256(string_agg(hash, '' ORDER BY step, idx)) AS proof FROM beside GROUP BY rid),
sides AS (SELECT rid, step, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (left_of), '') AS l,
    coalesce(string_agg(hash, '' ORDER BY idx) FILTER (NOT left_of), '') AS r FROM beside GROUP BY rid, step),
heights AS (SELECT b.rid, b.other, t.height + (SELECT max(lvl) FROM upper) AS steps, t.hash AS subroot
  FROM base b JOIN tops t USING (grp)),
folded AS (SELECT rid, 0 AS step, steps, other AS hash FROM heights UNION ALL
  SELECT f.rid, f.step + 1, f.steps, sha256(coalesce(s.l, '') || f.hash || coalesce(s.r, ''))
  FROM folded f LEFT JOIN sides s ON s.rid = f.rid AND s.step = f.step WHERE f.step < f.steps)
SELECT b.doc_id, b.leaf, h.subroot, (SELECT hash FROM root) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
    f.hash AS folded_root, f.hash = (SELECT hash FROM root) AS verified
FROM base b JOIN heights h USING (rid) JOIN folded f ON f.rid = b.rid AND f.step = f.steps
LEFT JOIN proofs p ON p.rid = b.rid
""".format(
    leaf="sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
                                 for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")",
    fields=" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars")),
    changed="coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN "
            f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE text END, '-')",
)


@query("op13_merkle", OP13_SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = merkle.leaf_of([*head, merkle.tampered(F.col("text"), F.col("doc_id"))])
    made = merkle.manifest(docs, merkle.leaf_of([*head, F.col("text")]), F.col("source"), [F.col("doc_id")],
                           F.struct("doc_id", changed.alias("changed")))
    folded = merkle.fold(F.col("path"), F.col("row.changed"))
    return made.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.by_component(*whitening.whiten(table(spark, sf_dir, "embeddings")))


@query("op12_neighbours")
def op12(spark, sf_dir):
    found = hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")
