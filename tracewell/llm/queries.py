"""The registered training-data queries: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_leaks
from .html_extract import extract_main_text
from .kd_shard import shard
from .language_id import identify_language
from .lexicon_bpe import bpe_codec
from .near_dups import near_duplicates
from .quality_model import score_quality
from .quality_rules import STOP_WORDS, quality
from .spelling import spelling_forms, typed_words
from .substring_dedup import dedup_substrings
from .tables import table
from .toxicity import score_toxicity
from .turn_repair import damage, repair_conversations
from .vector_join import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), only=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op3_superkmer_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(p)
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM g
), c AS (
  SELECT DISTINCT doc_id, q FROM f, unnest(generate_series(p, p + 12)) AS t(q) WHERE least < doc_id
), e AS (
  SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT w.doc_id, ws, list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM w LEFT JOIN e USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@query
def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size", "n_links")


@query
def op5_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


@query
def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), only=["doc_id"])


@query
def op2_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), only=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op2_threshold_table"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, p, array_to_string(ws[p:p+7], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 7)) AS u(p)
), r AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM r, unnest(generate_series(p, p + 7)) AS u(q) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
         CAST(length(bare) - length(translate(bare, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(bare, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
         len(list_filter(ws, lambda x: rtrim(lower(x), '.,;:!?') IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop
  FROM w LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars * 1000 >= 2000 * n_words AND word_chars * 1000 <= 14000 * n_words
       AND n_symbols * 1000 <= 80 * word_chars AND n_stop * 1000 >= 30 * n_words
       AND n_dup_lines * 1000 <= 500 * n_lines AND n_upper * 1000 <= 400 * word_chars AS kept
FROM b
"""


@query
def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), only=["doc_id"])


@query
def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"), only=["doc_id"])


@query
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_dom_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The crc32 of a list of bytes in SQL: its table, and the fold over the list that {0} stands for.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i)
  )
)"""
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


@query
def op11_turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_conversations(damage(table(spark, sf_dir, "conversations")), present="present")
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


_LEAST = "list_sort([{}])[1]"
_STEP = "{{'c': {0}.c + {1}, 'a': {0}.a || {2}}}"


def _fold_sql() -> str:
    """The four states after a turn, without insertions (they only come after it)."""
    more = "(CASE WHEN must_go THEN 1000000000000 WHEN cut THEN 5 ELSE 0 END)"
    role = lambda x, i: _STEP.format(x, f"(CASE WHEN initial = '{i}' THEN 0 ELSE 1 END) + {more}", f"CASE WHEN initial = '{i}' THEN 'K' ELSE 'R' END")
    gone = lambda x: _STEP.format(x, 2, "'D'")
    system = _STEP.format("n", f"(CASE WHEN initial = 's' THEN 0 ELSE 1000000000000 END) + {more}", "'K'")
    return f"""{gone("n")} AS n, {_LEAST.format(gone("s") + ", " + system)} AS s,
           {_LEAST.format(", ".join([gone("u"), role("n", "u"), role("s", "u"), role("a", "u")]))} AS u,
           {_LEAST.format(", ".join([gone("a"), role("u", "a")]))} AS a"""


def _inserted_sql() -> str:
    put = lambda x, k=1: _STEP.format(x, 5 * k, f"'{'I' * k}'")
    return f"""n, s, {_LEAST.format(", ".join(["u", put("n"), put("s"), put("a")]))} AS u,
           {_LEAST.format(", ".join(["a", put("u"), put("n", 2), put("s", 2)]))} AS a"""


ORACLES["op11_turn_fold"] = rf"""
WITH RECURSIVE {CRC_TABLE}, k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS kind FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS c(copy) WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         count(*) OVER (PARTITION BY conv_id) AS n_rows FROM o
), f AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM w
), t AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, fault = 'truncated' AS cut FROM f
), start AS (
  SELECT {{'c': 0::BIGINT, 'a': ''}} AS n, {{'c': 1000000000000, 'a': ''}} AS s, {{'c': 1000000000000, 'a': ''}} AS u, {{'c': 1000000000000, 'a': ''}} AS a
), r(conv_id, pos, n, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, n, s, u, a FROM (SELECT {_inserted_sql()} FROM start), conversations
  UNION ALL
  SELECT conv_id, pos, {_inserted_sql()} FROM (
    SELECT t.conv_id, t.pos, {_fold_sql()} FROM r JOIN t ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND t.pos = r.pos + 1)
), e AS (
  SELECT conv_id, arg_max({_LEAST.format("n, a")}, pos) AS best FROM r GROUP BY conv_id
), j AS (
  SELECT conv_id, j, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS pos,
         sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS out_no
  FROM (SELECT conv_id, g AS j, best.a[g] AS letter FROM e, unnest(generate_series(1, length(best.a))) AS x(g))
), l AS (
  SELECT j.*, t.role, t.text, max(CASE WHEN letter = 'K' AND out_no = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY j.conv_id) AS shift
  FROM j LEFT JOIN t ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.pos = t.pos AND j.letter <> 'I'
), x AS (
  SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (out_no - 1 + shift) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole
  FROM l WHERE letter <> 'D' GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pos > 1 AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM e LEFT JOIN x ON e.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op12_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(typed_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


_UTF8 = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))"

ORACLES["op12_spelling_automata"] = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7
), hashed AS (
  SELECT run, n, {CRC.format(_UTF8.format("doc_id || ':' || run"))} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), crc
), typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(generate_series(1, length(word))) AS t(p)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, list_sort(list({{'less': -near_n, 'form': near}}))[1] AS best FROM near GROUP BY word
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * words.n THEN best.form END AS form,
         CASE WHEN -best.less >= 10 * words.n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)
), up(word, root, step) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT up.word, forms.form, step + 1 FROM up JOIN forms ON up.root = forms.word WHERE forms.form IS NOT NULL
)
SELECT word, form, arg_max(up.root, step) AS root, n, n_near, form_n FROM forms JOIN up USING (word) GROUP BY ALL
"""


@query
def op13_metric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


ORACLES["op13_metric_cells"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(u, v) AS (
  SELECT u, v FROM l UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u
), c AS (
  SELECT u, min(v) AS v FROM reach GROUP BY u
), d AS (
  SELECT u, count(*) AS n FROM l GROUP BY u
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(v, vec_id)) AS component_id, least(vec_id, coalesce(v, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.u LEFT JOIN d ON vec_id = d.u
"""
