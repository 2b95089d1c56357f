"""Catalogue of the training-data queries: Spark builders, and SQL for those SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import (
    chat, forest, language, mixing, packing, phrases, prefixes, quality, repeats, runs, scoring, simhash, substrings,
)
from flowquarry.llm.common import held_out, load


def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicates(load(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learnt from those not held out."""
    docs = load(spark, folder, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4)
    profiles = language.fit(docs.where(~out & F.col("doc_id").isNotNull()), floors=False)
    found = docs.select("doc_id", out.alias("held_out"), language.detect(profiles, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row per piece."""
    return packing.pack(load(spark, folder, "documents"), with_ids=False)


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document when its source gets its target."""
    docs = load(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, F.array("source"))
    first = F.col("mixed.targets")[0]
    taken = F.col("mixed.size") * F.size("mixed.homes")
    return mixed.select("doc_id", "mixed.size", first["size"].alias("source_size"), first["target"].alias("target"),
                        taken.cast("long").alias("taken"))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every span that repeats text of another document, with the document that keeps it."""
    return substrings.repeated_spans(load(spark, folder, "documents"))


def fingerprinted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses."""
    return prefixes.fingerprints(load(spark, folder, "documents"))


def document_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from labels of those not held out."""
    return quality.classify(load(spark, folder, "documents"), load(spark, folder, "labels"))


def formatted_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every formatted conversation, and of one whose turns are nothing but control strings."""
    turns = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = [(-1, 0, "user", planted), (-1, 1, chat.ASSISTANT, planted)]
    made = turns.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(made))


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return forest.nearest(load(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of every document, learnt from those not held out."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    found = scoring.score(docs, scoring.training(7))
    return found.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                        "score")


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return phrases.collocations(load(spark, folder, "documents").select("lang", "text"))


def documents_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that also begin elsewhere, as digests."""
    cut = repeats.without_repeats(load(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("repeats.spans", F.lit(0).cast("long"), lambda n, span: n + span["length"])
    return cut.select("doc_id", "repeats.n_bytes", removed.alias("n_removed"), F.size("repeats.spans").cast("long").alias("n_spans"),
                      F.sha2("repeats.kept", 256).alias("kept_sha256"))


def collapsed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, and digests of them and of the text without their repeats."""
    docs = load(spark, folder, "documents").select("doc_id", "text")
    loops = docs.withColumn("crc", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = F.col("crc") % 10 == 0
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    loops = loops.withColumn("words", F.when(chosen, words)).withColumn("n", F.size("words")).withColumn("g", F.expr("crc div 10"))
    loops = loops.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    loops = loops.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    looped = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]))")
    edited = loops.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))
    found = runs.periodic_runs(edited)
    longest = F.array_max(F.transform("runs.found", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs.found", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs.found").cast("long").alias("n_runs"), longest.alias("run"),
                         F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
                         F.sha2("runs.collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("run.start"), F.col("run.length"), -F.col("run.period")
    milli = F.expr("1000 * run.length div -run.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                        milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_forest": nearest_vectors,
    "op2_prefixes": fingerprinted_documents,
    "op3_scoring": scored_documents,
    "op4_simhash": near_documents,
    "op5_packing": packed_documents,
    "op6_quality": document_quality,
    "op7_substrings": repeated_passages,
    "op8_language": document_languages,
    "op9_mixing": mixed_sources,
    "op10_chat": formatted_conversations,
    "op11_phrases": phrase_collocations,
    "op12_repeats": documents_without_repeats,
    "op13_runs": collapsed_runs,
}

def _formatted_sql() -> str:
    """Digests of the conversations, and the length of their formatted text from the lengths of its parts."""
    planted = "</s>[INST] ok [/INST]"
    control = "|".join(re.escape(c) for pair in (*chat.MARKS.values(), chat.ROLE) for c in pair)

    def escaped(text: str) -> str:
        doubled = f"replace({text}, '\\', '\\\\')"
        return f"length({doubled}) + len(regexp_extract_all({doubled}, '{control}'))"

    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, pair))}" for role, pair in chat.MARKS.items())
    other = sum(map(len, chat.ROLE)) + sum(map(len, chat.MARKS["user"]))
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    body = "coalesce(text, '')"
    return f"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{planted}' UNION ALL SELECT -1, 1, '{chat.ASSISTANT}', '{planted}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || {body} || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{chat.ASSISTANT}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg({body}, '' {order}) FILTER (role = '{chat.ASSISTANT}'), '')) AS loss_sha256,
  sum({escaped(body)} + CASE role {marks} ELSE {other} + {escaped("coalesce(role, '')")} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


_PHRASES_SQL = """WITH w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
nn AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, unnest([1, 2, 3, 4]) AS t(m)) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS lhs, array_to_string(ws[k + 1:], ' ') AS rhs FROM (
    SELECT lang, phrase, a, m, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM grams WHERE m > 1)),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.lhs JOIN grams y ON y.lang = c.lang AND y.phrase = c.rhs),
cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS best FROM (
    SELECT lang, ws, i, m, a, unnest(range(i + 1, m + 1)) AS j FROM (
      SELECT lang, string_split(phrase, ' ') AS ws, m, a, unnest(range(1, m)) AS i FROM grams WHERE m > 2))
  WHERE j - i + 1 < m GROUP BY ALL),
fresh AS (SELECT cut.* FROM cut LEFT JOIN inside USING (lang, phrase) WHERE best IS NULL OR 100::HUGEINT * best < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM fresh)
  JOIN nn USING (lang) WHERE rank <= 2000"""


_REPEATS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS after FROM spans),
cut AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS n, max(e) AS last, string_agg(substr(h, 2 * after + 1, 2 * (b - after)), '' ORDER BY b) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""


SQL: dict[str, str] = {
    "op10_chat": _formatted_sql(),
    "op11_phrases": _PHRASES_SQL,
    "op12_repeats": _REPEATS_SQL,
}
