"""Segments, words, fitting and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import fitting as ft
from voxtable.functions import text as tx
from voxtable.operators import context as cx
from voxtable.operators import quality as ql
from voxtable.operators import subtitles as st
from voxtable.operators import words as wd
from voxtable.plans.registry import query
from voxtable.plans.views import table, view
from voxtable.session import spread

EP = ["episode_id"]

# Token i of n in a line gets an equal share of the line's time.
TOK_SQL = """tok AS (SELECT episode_id, ord, speaker_id, start_ms, end_ms, zh_text, t, i, n,
   start_ms + i*(end_ms-start_ms)//n AS s, start_ms + (i+1)*(end_ms-start_ms)//n AS e FROM (
   SELECT *, unnest(string_split(zh_text,' ')) AS t, CAST(generate_subscripts(string_split(zh_text,' '),1)-1 AS BIGINT) AS i,
     len(string_split(zh_text,' ')) AS n FROM segment))"""
# The one-element array binds the tokens once, so the inner lambda does not split the text per token.
def bound(body: str) -> str:
    return ("element_at(transform(array(named_struct('toks', split(zh_text, ' '), 'n', size(split(zh_text, ' ')), 's', start_ms, 'd', end_ms - start_ms)), b -> "
            f"{body}), 1)")


WORDS = bound("transform(b.toks, (t, i) -> named_struct('t', t, 'i', i, "
              "'s', b.s + CAST(i AS BIGINT)*b.d DIV b.n, 'e', b.s + CAST(i+1 AS BIGINT)*b.d DIV b.n))")
# Planted alignment faults, by line: low score, outside the window, out of order, missing, no score.
RAW = f"""element_at(transform(array(named_struct('w', {WORDS}, 'e', end_ms)), c -> transform(filter(c.w, w -> NOT ((episode_id+ord)%6=4 AND w.e = c.e)), w -> named_struct(
  'word', w.t, 'start', (w.s - CASE WHEN (episode_id+ord)%6=3 AND w.i=3 THEN 150 ELSE 0 END)/1000.0D,
  'end', (CASE WHEN (episode_id+ord)%6=2 AND w.i=1 THEN c.e+500 ELSE w.e END)/1000.0D,
  'score', CASE WHEN (episode_id+ord)%6=5 AND w.i=0 THEN CAST(NULL AS DOUBLE) WHEN (episode_id+ord)%6=1 AND w.i=2 THEN 0.001D ELSE 0.5D END))), 1)"""
RAW_SQL = TOK_SQL + """, raw AS (SELECT * REPLACE (s - CASE WHEN (episode_id+ord)%6=3 AND i=3 THEN 150 ELSE 0 END AS s,
    CASE WHEN (episode_id+ord)%6=2 AND i=1 THEN end_ms+500 ELSE e END AS e),
    CASE WHEN (episode_id+ord)%6=5 AND i=0 THEN NULL WHEN (episode_id+ord)%6=1 AND i=2 THEN 0.001 ELSE 0.5 END AS score
    FROM tok WHERE NOT ((episode_id+ord)%6=4 AND i=n-1)),
 judged AS (SELECT *, CASE WHEN score IS NULL THEN 'MISSING_OR_INVALID_WORD_ALIGNMENT'
    WHEN NOT (start_ms <= s AND s < e AND e <= end_ms) THEN 'WORD_OUTSIDE_ASR_WINDOW' WHEN score < 0.01 OR score > 1 THEN 'LOW_CTC_MATCH_SCORE' END AS wr
    FROM raw WHERE length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) > 0),
 seq AS (SELECT *, CASE WHEN wr IS NULL AND lag(e) OVER w > s THEN 'NON_MONOTONIC_WORD_ALIGNMENT' ELSE wr END AS r
    FROM judged WINDOW w AS (PARTITION BY episode_id, ord ORDER BY i)),
 grp AS (SELECT episode_id, ord, min(i) FILTER (WHERE r IS NOT NULL) AS bad_at, arg_min(r, i) FILTER (WHERE r IS NOT NULL) AS first_reason,
    string_agg(t, '' ORDER BY i) AS got, min(s) AS s0, max(e) AS e0, count(*) AS n_words FROM seq GROUP BY ALL),
 verdict AS (SELECT s.episode_id, s.ord, s.action, s.needs_review, CASE WHEN first_reason IS NOT NULL THEN first_reason
    WHEN got IS NULL OR regexp_replace(got, '[^\\p{L}\\p{N}]', '', 'g') <> regexp_replace(zh_text, '[^\\p{L}\\p{N}]', '', 'g') THEN 'INCOMPLETE_TEXT_ALIGNMENT'
    WHEN e0 - s0 < 100 THEN 'COLLAPSED_UTTERANCE_ALIGNMENT' END AS reason, n_words
    FROM segment s LEFT JOIN grp USING (episode_id, ord))"""


def segments_with_words(spark, sf):
    return spread(view(spark, sf, "segment")).withColumn(
        "words", F.expr(f"transform({WORDS}, w -> named_struct('t', w.t, 's', w.s, 'e', w.e))"))


def raw_alignments(spark, sf):
    return spread(view(spark, sf, "segment")).withColumn("raw_words", F.expr(RAW)).withColumn(
        "confidence", F.create_map(F.lit("asr"), F.lit(0.9)))


# The library emits literals above as plain SQL expressions over the segment row.
@query("word_table", "WITH " + TOK_SQL + " SELECT episode_id, ord, i AS pos, t, s, e FROM tok")
def word_table(spark, sf):
    return segments_with_words(spark, sf).select("episode_id", "ord", F.posexplode("words").alias("pos", "w")).select(
        "episode_id", "ord", F.col("pos").cast("long").alias("pos"), "w.t", "w.s", "w.e")


@query("alignment_word_verdicts", "WITH " + RAW_SQL + " SELECT episode_id, ord, i AS pos, wr AS reason FROM judged")
def alignment_word_verdicts(spark, sf):
    raw = raw_alignments(spark, sf).select("episode_id", "ord", "start_ms", "end_ms", F.posexplode("raw_words").alias("pos", "w"))
    raw = raw.where(F.char_length(F.regexp_replace("w.word", r"[^\p{L}\p{N}]", "")) > 0)
    return raw.select("episode_id", "ord", F.col("pos").cast("long").alias("pos"),
                      wd.word_verdict(F.col("w"), F.col("start_ms"), F.col("end_ms")).alias("reason"))


@query("alignment_group_verdicts", "WITH " + RAW_SQL + """ SELECT episode_id, ord, reason,
  CASE WHEN reason IS NULL THEN n_words ELSE 0 END AS n_words FROM verdict""")
def alignment_group_verdicts(spark, sf):
    out = wd.alignment_verdicts(raw_alignments(spark, sf))
    return out.select("episode_id", "ord", "reason", F.size("words").cast("long").alias("n_words"))


@query("alignment_failure_preserved", "WITH " + RAW_SQL + """ SELECT v.episode_id, v.ord, s.start_ms, s.end_ms, s.zh_text,
  CASE WHEN reason IS NOT NULL THEN 'NEEDS_REVIEW' ELSE v.action END AS action, (reason IS NOT NULL OR v.needs_review) AS needs_review,
  CASE WHEN reason IS NULL THEN 0.9::DOUBLE END AS asr_confidence FROM verdict v JOIN segment s USING (episode_id, ord)""")
def alignment_failure_preserved(spark, sf):
    out = wd.review_fallback(wd.alignment_verdicts(raw_alignments(spark, sf)))
    return out.select("episode_id", "ord", "start_ms", "end_ms", "zh_text", "action", "needs_review",
                      F.col("confidence")["asr"].alias("asr_confidence"))


@query("alignment_rollup", "WITH " + RAW_SQL + """ SELECT episode_id, CAST(count_if(reason IS NULL) AS BIGINT) AS aligned_segments, bool_and(reason IS NULL) AS word_timing_available,
  CASE WHEN bool_and(reason IS NULL) THEN 'ALIGNED' ELSE 'PARTIAL_REVIEW_REQUIRED' END AS alignment_status,
  CAST(sum(s.end_ms - s.start_ms) AS BIGINT) AS processed_media_ms FROM verdict JOIN segment s USING (episode_id, ord) GROUP BY episode_id""")
def alignment_rollup(spark, sf):
    return wd.alignment_rollup(wd.alignment_verdicts(raw_alignments(spark, sf)), EP)


NATIVE = f"""element_at(transform(array(named_struct('w', {WORDS}, 's', start_ms, 'e', end_ms)), c -> transform(c.w, w -> named_struct('word', w.t, 'start', (w.s-c.s)/1000.0D,
  'end', (CASE WHEN w.i%7=3 THEN w.s+10 WHEN w.i%11=5 THEN c.e+40 ELSE w.e END - c.s)/1000.0D, 'score', 1.0D))), 1)"""


@query("native_word_issues", "WITH " + TOK_SQL + """, x AS (SELECT episode_id, ord, t, s, CASE WHEN i%7=3 THEN s+10 WHEN i%11=5 THEN end_ms+40 ELSE e END AS e, start_ms, end_ms FROM tok),
  y AS (SELECT *, (start_ms <= s AND s < e AND e <= end_ms) AS inside FROM x)
SELECT episode_id, ord, 'VERY_SHORT_NATIVE_WORD_TIME' AS code, t AS token, s, e FROM y WHERE inside AND e-s < 20
UNION ALL SELECT episode_id, ord, 'INVALID_NATIVE_WORD_TIME', t, s, e FROM y WHERE NOT inside
UNION ALL SELECT episode_id, ord, 'NATIVE_WORD_TIMING_UNAVAILABLE', NULL, NULL, NULL FROM y GROUP BY episode_id, ord HAVING NOT bool_or(inside)""")
def native_word_issues(spark, sf):
    out = wd.native_words(view(spark, sf, "segment").withColumn("raw_words", F.expr(NATIVE)))
    return out.select("episode_id", "ord", F.inline("issues"))


@query("dub_keep_decision", """
SELECT episode_id, ord, action, needs_review, speech_kind, speaker_id FROM (
 SELECT episode_id, ord, CASE WHEN ov OR nv OR nw THEN 'KEEP' ELSE 'DUB' END AS action, (ov OR nw) AS needs_review,
   CASE WHEN nv THEN 'nonverbal' ELSE 'lexical' END AS speech_kind, CASE WHEN NOT ov THEN role END AS speaker_id FROM (
  SELECT conv_id AS episode_id, turn AS ord, role, (conv_id+turn)%5=0 AS ov, (conv_id*turn)%7=3 AS nw, length(text)%9=4 AS nv FROM conversations))""")
def dub_keep_decision(spark, sf):
    lines = table(spark, sf, "conversations").selectExpr(
        "conv_id AS episode_id", "turn AS ord",
        "CASE WHEN length(text)%9=4 THEN '啊，嗯！' ELSE text END AS zh_text",
        "CASE WHEN (conv_id*turn)%7=3 THEN filter(array('x'), x -> false) ELSE array('x') END AS words",
        "CASE WHEN (conv_id+turn)%5=0 THEN array(role, 'other') ELSE array(role) END AS speaker_ids")
    return wd.dub_decision(lines).select("episode_id", "ord", "action", "needs_review", "speech_kind", "speaker_id")


@query("unresolved_lines", """SELECT episode_id, ord, action FROM segment WHERE needs_review OR action='NEEDS_REVIEW'
  OR (action='DUB' AND (trim(zh_text)='' OR episode_id%9=4))""")
def unresolved_lines(spark, sf):
    lines = view(spark, sf, "segment").withColumn("dub_vi", F.expr("CASE WHEN episode_id%9=4 THEN '  ' ELSE zh_text END"))
    return st.unresolved(lines).select("episode_id", "ord", "action")


@query("fitting_action", """SELECT episode_id, ord, actual_ms, end_ms-start_ms AS target_ms, attempts,
  CASE WHEN d <= 0.08 THEN 'STRETCH' WHEN attempts >= 3 THEN 'NEEDS_REVIEW' WHEN d <= 0.20 THEN 'SPEED' ELSE 'REWRITE' END AS action
 FROM (SELECT *, abs(actual_ms-(end_ms-start_ms))/CAST(end_ms-start_ms AS DOUBLE) AS d FROM segment JOIN clip USING (episode_id, ord))""")
def fitting_action(spark, sf):
    both = view(spark, sf, "segment").drop("action").join(view(spark, sf, "clip"), ["episode_id", "ord"])
    target = (F.col("end_ms") - F.col("start_ms")).alias("target_ms")
    return both.select("episode_id", "ord", "actual_ms", target, "attempts",
                       ft.fitting_action(F.col("actual_ms"), F.col("end_ms") - F.col("start_ms"), F.col("attempts")).alias("action"))


@query("fit_decision", """SELECT episode_id, ord, CASE WHEN d > 0.20 THEN 'REWRITE' WHEN d <= 0.08 THEN 'STRETCH' ELSE 'SPEED' END AS action,
  CASE WHEN d <= 0.20 THEN f END AS speed_factor, CASE WHEN d <= 0.20 THEN least(greatest(f, 0.90), 1.45) END AS elastic_factor, d > 0.20 AS review_required
 FROM (SELECT *, abs(actual_ms-(end_ms-start_ms))/CAST(end_ms-start_ms AS DOUBLE) AS d, actual_ms/CAST(end_ms-start_ms AS DOUBLE) AS f FROM segment JOIN clip USING (episode_id, ord))""")
def fit_decision(spark, sf):
    both = view(spark, sf, "segment").drop("action").join(view(spark, sf, "clip"), ["episode_id", "ord"])
    actual, target = F.col("actual_ms"), F.col("end_ms") - F.col("start_ms")
    act = ft.fit_decision(actual, target)
    return both.select("episode_id", "ord", act.alias("action"), ft.speed_factor(actual, target).alias("speed_factor"),
                       ft.speed_factor(actual, target, elastic=True).alias("elastic_factor"), (act == "REWRITE").alias("review_required"))


@query("slot_fit", """
WITH v AS (SELECT s.*, actual_ms, start_ms + (episode_id*7+ord)%400 AS first_ms FROM segment s JOIN clip USING (episode_id, ord) WHERE action='DUB' AND NOT missing),
 f AS (SELECT *, greatest(1.0, actual_ms/CAST(end_ms-first_ms AS DOUBLE)) AS factor FROM v),
 k AS (SELECT episode_id, start_ms - 5000 AS start_ms, start_ms + 4000 AS end_ms FROM segment WHERE action<>'DUB'),
 h AS (SELECT *, first_ms + actual_ms/factor AS right_ms FROM f)
SELECT episode_id, ord, round(factor, 9) AS factor, CASE WHEN factor > 1.2 THEN 'VOICE_EXCEEDS_FROZEN_DURATION_POLICY'
  WHEN right_ms > end_ms + 10 THEN 'FIT_OVERFLOW_KEEP_ORIGINAL'
  WHEN EXISTS (SELECT 1 FROM k WHERE k.episode_id=h.episode_id AND k.start_ms < right_ms AND k.end_ms > first_ms) THEN 'PROTECTED_EVENT_COLLISION_KEEP_ORIGINAL' END AS issue FROM h""")
def slot_fit(spark, sf):
    seg = view(spark, sf, "segment")
    voiced = seg.where("action = 'DUB'").join(view(spark, sf, "clip").where("NOT missing"), ["episode_id", "ord"]).selectExpr(
        "episode_id", "ord", "start_ms", "end_ms", "actual_ms", "start_ms + (episode_id*7+ord)%400 AS first_ms")
    protected = seg.where("action <> 'DUB'").selectExpr("episode_id", "start_ms - 5000 AS start_ms", "start_ms + 4000 AS end_ms")
    out = st.fitted_slots(voiced, protected, EP, ident="ord")
    return out.select("episode_id", "ord", F.round("factor", 9).alias("factor"), "issue")


@query("tempo_chain", """
SELECT p_partkey AS part, array_to_string(list_transform(CASE WHEN f > 2 THEN list_concat(list_transform(range(0, d), lambda x: 2.0), [f/pow(2,d)])
   WHEN f < 0.5 THEN list_concat(list_transform(range(0, h), lambda x: 0.5), [f*pow(2,h)]) ELSE [f] END, lambda v: CAST(CAST(round(v*1000000) AS BIGINT) AS VARCHAR)), ',') AS chain
FROM (SELECT *, CAST(greatest(0, ceil(log2(f))-1) AS BIGINT) AS d, CAST(greatest(0, ceil(-log2(f))-1) AS BIGINT) AS h FROM (
  SELECT p_partkey, (1+p_partkey%97)/CAST(1+p_size%13 AS DOUBLE) AS f FROM part))""")
def tempo_chain(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS part", "(1+p_partkey%97)/CAST(1+p_size%13 AS DOUBLE) AS f")
    micro = F.transform(ft.tempo_chain(F.col("f")), lambda v: F.round(v * 1_000_000).cast("long").cast("string"))
    return parts.select("part", F.array_join(micro, ",").alias("chain"))


@query("clip_coverage", """SELECT s.episode_id, count(*) AS dub_lines, CAST(count_if(c.missing) AS BIGINT) AS missing_clips,
  min(s.ord) FILTER (c.missing) AS first_missing FROM segment s JOIN clip c USING (episode_id, ord) WHERE action='DUB' GROUP BY s.episode_id""")
def clip_coverage(spark, sf):
    dubs = view(spark, sf, "segment").where("action = 'DUB'")
    clips = view(spark, sf, "clip").where("NOT missing").select("episode_id", "ord", "actual_ms")
    return st.clip_coverage(dubs, clips, EP, "ord")


@query("missing_clips", "SELECT s.episode_id, s.ord, s.segment_id FROM segment s JOIN clip c USING (episode_id, ord) WHERE action='DUB' AND c.missing")
def missing_clips(spark, sf):
    clips = view(spark, sf, "clip").where("NOT missing").select("episode_id", "ord")
    return st.missing_clips(view(spark, sf, "segment").where("action = 'DUB'"), clips, EP, "ord").select("episode_id", "ord", "segment_id")


@query("character_error_rate", """
SELECT episode_id, ord, length(r) AS ref_chars, CASE WHEN length(r) > 0 THEN levenshtein(a(r), a(h))/CAST(length(r) AS DOUBLE) END AS cer FROM (
 SELECT conv_id AS episode_id, turn AS ord, n(text) AS r, n(replace(replace(text, 'en', 'n'), 'é', 'e')) AS h FROM conversations)"""
       .replace("a(r)", "translate(r, {A}, {B})").replace("a(h)", "translate(h, {A}, {B})")
       .replace("n(text)", "regexp_replace(translate(nfc_normalize(text), {P}, {S}), '\\s+', '', 'g')")
       .replace("n(replace(replace(text, 'en', 'n'), 'é', 'e'))",
                "regexp_replace(translate(nfc_normalize(replace(replace(text, 'en', 'n'), 'é', 'e')), {P}, {S}), '\\s+', '', 'g')")
       .replace("{A}", "'ÄñÊÈÑéèÍßÉêçíÇüöÖóÓäÜ'")
       .replace("{B}", "||".join(f"chr({i})" for i in range(1, 22)).join("()"))
       .replace("{P}", "'" + tx.COMPARE_PUNCTUATION.replace("'", "''") + "'").replace("{S}", "repeat(' ', 40)"))
def character_error_rate(spark, sf):
    pairs = table(spark, sf, "conversations").selectExpr(
        "conv_id AS episode_id", "turn AS ord", "text AS reference", "replace(replace(text, 'en', 'n'), 'é', 'e') AS hypothesis")
    return ql.error_rates(pairs).select("episode_id", "ord", "ref_chars", "cer")


@query("joined_transcript", "SELECT episode_id, string_agg(zh_text, '' ORDER BY ord) AS text FROM segment GROUP BY episode_id")
def joined_transcript(spark, sf):
    return ql.joined_text(view(spark, sf, "segment"), EP, "ord", "zh_text")


@query("transcript_error_rate", """SELECT episode_id, length(r) AS ref_chars, levenshtein(r, h) AS edits, CASE WHEN length(r) > 0 THEN levenshtein(r, h)/CAST(length(r) AS DOUBLE) END AS cer FROM (
 SELECT episode_id, string_agg(p, '' ORDER BY ord) AS r, string_agg(CASE WHEN ord%5=2 THEN reverse(p) WHEN ord%7<>3 THEN p ELSE '' END, '' ORDER BY ord) AS h FROM (
  SELECT episode_id, ord, translate(regexp_replace(translate(nfc_normalize(zh_text), {P}, {S}), '\\s+', '', 'g'), {A}, {B}) AS p FROM segment) GROUP BY episode_id)"""
       .replace("{A}", "'ÄñÊÈÑéèÍßÉêçíÇüöÖóÓäÜ'").replace("{B}", "||".join(f"chr({i})" for i in range(1, 22)))
       .replace("{P}", "'" + tx.COMPARE_PUNCTUATION.replace("'", "''") + "'").replace("{S}", "repeat(' ', 40)"))
def transcript_error_rate(spark, sf):
    """Whole transcripts: every fifth line is heard backwards, every seventh not at all."""
    lines = view(spark, sf, "segment").withColumn("plain", tx.normalize_chinese(F.col("zh_text")))
    heard = lines.withColumn("plain", F.expr("CASE WHEN ord%5=2 THEN reverse(plain) WHEN ord%7<>3 THEN plain ELSE '' END"))
    pairs = ql.joined_text(lines, EP, "ord", "plain").withColumnRenamed("text", "reference").join(
        ql.joined_text(heard, EP, "ord", "plain").withColumnRenamed("text", "hypothesis"), EP)
    return ql.transcript_error_rates(pairs).select("episode_id", "ref_chars", "edits", "cer")


@query("word_boundary_error")
def word_boundary_error(spark, sf):
    cases = segments_with_words(spark, sf).withColumn(
        "heard", F.expr("transform(filter(words, (w, i) -> i % 9 <> 4), (w, i) -> named_struct('t', w.t, 's', w.s + i % 5 * 10, 'e', w.e - i % 3 * 5))"))
    out = ql.word_boundary_errors(cases, "words", "heard")
    return out.select("episode_id", "ord", "boundary.matched_words", "boundary.compared_boundaries",
                      "boundary.median_abs_error_ms", "boundary.p95_abs_error_ms")


# Words are contiguous here, so no pause cuts; only the last piece of a line can be short.
UTT_SQL = TOK_SQL + """, ln AS (SELECT DISTINCT episode_id, ord, start_ms AS lo, end_ms - start_ms AS d, n FROM tok),
 walk AS (SELECT t.episode_id, t.ord, t.i, CAST(0 AS BIGINT) AS head FROM tok t WHERE i=0
   UNION ALL SELECT w.episode_id, w.ord, p.i + 1, CASE WHEN p.t LIKE '%.' AND p.e - (p.start_ms + w.head*(p.end_ms-p.start_ms)//p.n) >= 800 THEN p.i + 1 ELSE w.head END
     FROM walk w JOIN tok p ON p.episode_id=w.episode_id AND p.ord=w.ord AND p.i=w.i AND p.i + 1 < p.n),
 mk AS (SELECT episode_id, ord, list(CASE WHEN t LIKE '%.' THEN 1000 WHEN t LIKE '%,' THEN 250 ELSE 0 END ORDER BY i) AS bonus FROM tok GROUP BY episode_id, ord),
 cut AS (SELECT w.episode_id, w.ord, head AS a, max(i) + 1 AS b, lo, d, n, bonus, true AS fresh FROM walk w JOIN ln USING (episode_id, ord) JOIN mk USING (episode_id, ord) GROUP BY ALL
   UNION ALL SELECT episode_id, ord, unnest([a, c]), unnest([c, b]), lo, d, n, bonus, true FROM (
     SELECT *, coalesce(-list_max(list_transform(list_filter(range(a+1, b), lambda x: (x*d//n) - (a*d//n) >= 800 AND (b*d//n) - (x*d//n) >= 800),
        lambda x: [CAST(bonus[x] AS BIGINT), -abs((x*d//n) - (a*d//n) - ((b*d//n) - (x*d//n))), -x]))[3], a + greatest(1, (b-a)//2)) AS c
     FROM cut WHERE b - a >= 2 AND (b*d//n) - (a*d//n) > 12000)),
 leaf AS (SELECT * FROM cut WHERE b - a < 2 OR (b*d//n) - (a*d//n) <= 12000),
 sized AS (SELECT *, lag(a) OVER w AS pa, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM leaf WINDOW w AS (PARTITION BY episode_id, ord ORDER BY a)),
 fin AS (SELECT *, na IS NULL AND pa IS NOT NULL AND (b*d//n) - (a*d//n) < 800 AND (b*d//n) - (pa*d//n) <= 12000 AS gone,
   CASE WHEN nb = n AND (nb*d//n) - (na*d//n) < 800 AND (nb*d//n) - (a*d//n) <= 12000 THEN nb ELSE b END AS stop FROM sized)"""


@query("word_boundary_error_numbered", "WITH " + TOK_SQL + """, k AS (SELECT episode_id, ord, row_number() OVER (PARTITION BY episode_id, ord ORDER BY i) - 1 AS j FROM tok WHERE i%9 <> 4),
 x AS (SELECT episode_id, ord, unnest([j%5*10, j%3*5]) AS err FROM k)
SELECT s.episode_id, s.ord, CAST(count(err)//2 AS BIGINT) AS matched_words, CAST(count(err) AS BIGINT) AS compared_boundaries, CAST(median(err) AS DOUBLE) AS median_abs_error_ms,
  CAST(quantile_cont(err, 0.95) AS DOUBLE) AS p95_abs_error_ms FROM segment s LEFT JOIN x USING (episode_id, ord) GROUP BY s.episode_id, s.ord""")
def word_boundary_error_numbered(spark, sf):
    """The same on words that are told apart by their number, so that every match is certain."""
    numbered = segments_with_words(spark, sf).withColumn(
        "words", F.expr("transform(words, (w, i) -> named_struct('t', concat(w.t, 'x', i), 's', w.s, 'e', w.e))")).withColumn(
        "heard", F.expr("transform(filter(words, (w, i) -> i % 9 <> 4), (w, i) -> named_struct('t', w.t, 's', w.s + i % 5 * 10, 'e', w.e - i % 3 * 5))"))
    out = ql.word_boundary_errors(numbered, "words", "heard")
    return out.select("episode_id", "ord", "boundary.matched_words", "boundary.compared_boundaries",
                      "boundary.median_abs_error_ms", "boundary.p95_abs_error_ms")


@query("utterances", "WITH RECURSIVE " + UTT_SQL + """ SELECT f.episode_id, f.ord, s.segment_id, row_number() OVER (PARTITION BY f.episode_id, f.ord ORDER BY a) - 1 AS utterance_no,
  lo + a*d//f.n AS start_ms, lo + stop*d//f.n AS end_ms, (SELECT regexp_replace(replace(string_agg(t, ' ' ORDER BY i), '.', '。'), '^\\s+|\\s+$', '', 'g') FROM tok WHERE tok.episode_id=f.episode_id AND tok.ord=f.ord AND i >= a AND i < stop) AS text,
  CAST(stop - a AS INTEGER) AS n_words FROM fin f JOIN segment s USING (episode_id, ord) WHERE NOT gone""")
def utterances(spark, sf):
    """Words without their marks; the marks stand in the text, so that they decide the cuts."""
    marked = segments_with_words(spark, sf).selectExpr(
        "episode_id", "ord", "segment_id", "replace(zh_text, '.', '。') AS zh_text",
        "transform(words, w -> named_struct('t', replace(regexp_replace(w.t, '[.,]+$', ''), '.', '。'), 's', w.s, 'e', w.e)) AS words")
    return wd.build_utterances(marked, ["episode_id", "ord", "segment_id"]).select(
        "episode_id", "ord", "segment_id", "utterance_no", "start_ms", "end_ms", "text", F.size("words").alias("n_words"))


@query("aligned_utterance_slots", "WITH RECURSIVE " + RAW_SQL + """, cut AS (SELECT t.episode_id, t.ord, CAST(0 AS BIGINT) AS a, n AS b, t.start_ms AS lo, t.end_ms - t.start_ms AS d, n FROM tok t JOIN verdict v ON v.episode_id=t.episode_id AND v.ord=t.ord AND reason IS NULL WHERE i=0
   UNION ALL SELECT episode_id, ord, unnest([a, c]), unnest([c, b]), lo, d, n FROM (
     SELECT *, coalesce(-list_max(list_transform(list_filter(range(a+1, b), lambda x: (x*d//n) - (a*d//n) >= 800 AND (b*d//n) - (x*d//n) >= 800),
        lambda x: [-abs((x*d//n) - (a*d//n) - ((b*d//n) - (x*d//n))), -x]))[2], a + greatest(1, (b-a)//2)) AS c
     FROM cut WHERE b - a >= 2 AND (b*d//n) - (a*d//n) > 12000)),
 u AS (SELECT *, lo + a*d//n AS s0, row_number() OVER (PARTITION BY episode_id, ord ORDER BY a) - 1 AS utterance_no FROM cut WHERE b - a < 2 OR (b*d//n) - (a*d//n) <= 12000)
SELECT episode_id, ord, utterance_no, s0 AS start_ms, lo + b*d//n AS end_ms,
  (SELECT regexp_replace(string_agg(t, ' ' ORDER BY i), '^\\s+|\\s+$', '', 'g') FROM tok WHERE tok.episode_id=u.episode_id AND tok.ord=u.ord AND i >= a AND i < b) AS text,
  'seg_' || lpad(CAST(s0 AS VARCHAR), 12, '0') || '_' || lpad(CAST(utterance_no AS VARCHAR), 4, '0') AS segment_id FROM u""")
def aligned_utterance_slots(spark, sf):
    good = wd.alignment_verdicts(raw_alignments(spark, sf)).where("reason IS NULL")
    good = good.withColumnsRenamed({"start_ms": "slot_start", "end_ms": "slot_end"})
    made = wd.build_utterances(good, ["episode_id", "ord", "slot_start", "slot_end"], min_span_ms=wd.MIN_SPAN_MS)
    out = wd.slot_bounds(made, ["episode_id", "ord"])
    return out.select("episode_id", "ord", "utterance_no", "start_ms", "end_ms", "text",
                      tx.segment_id(F.col("start_ms"), F.col("utterance_no")).alias("segment_id"))


@query("sentence_segments", "WITH " + TOK_SQL + """, g AS (SELECT *, coalesce(sum(CASE WHEN contains(t, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM tok),
 p AS (SELECT episode_id, ord, k, min(s) AS s0, max(e) AS e0, min(start_ms) AS lo, max(end_ms) AS hi, string_agg(replace(t, '.', '。'), ' ' ORDER BY i) || CASE WHEN max(i) + 1 < max(n) THEN ' ' ELSE '' END AS wording FROM g GROUP BY episode_id, ord, k),
 c AS (SELECT *, count(*) OVER (PARTITION BY episode_id, ord) AS many FROM p)
SELECT c.episode_id, c.ord, segment_id || CASE WHEN many > 1 THEN ':s' || CAST(CAST(k AS BIGINT) AS VARCHAR) ELSE '' END AS segment_id, CASE WHEN many > 1 THEN s0 ELSE lo END AS start_ms,
  CASE WHEN many > 1 THEN e0 ELSE hi END AS end_ms, wording AS zh_text FROM c JOIN segment USING (episode_id, ord)""")
def sentence_segments(spark, sf):
    marked = segments_with_words(spark, sf).selectExpr(
        "episode_id", "ord", "segment_id", "start_ms", "end_ms", "replace(zh_text, '.', '。') AS zh_text",
        "transform(words, w -> named_struct('t', replace(w.t, '.', ''), 's', w.s, 'e', w.e)) AS words")
    return wd.split_sentences(marked).select("episode_id", "ord", "segment_id", "start_ms", "end_ms", "zh_text")


@query("repaired_words", "WITH RECURSIVE " + TOK_SQL + """, raw AS (SELECT *, s - (i*37)%250 AS rs, greatest(s - (i*37)%250 + 1, e - (i*91)%500) AS re FROM tok),
 fold AS (SELECT episode_id, ord, i, n, start_ms, end_ms, t, greatest(start_ms, rs) AS s0, re, rs, 0 AS dummy FROM raw WHERE false),
 step AS (SELECT episode_id, ord, CAST(-1 AS BIGINT) AS i, start_ms AS cur, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e FROM segment
  UNION ALL
  SELECT r.episode_id, r.ord, r.i, CASE WHEN greatest(greatest(greatest(r.start_ms, rs), cur)+1, re) > end_ms THEN end_ms ELSE greatest(greatest(greatest(r.start_ms, rs), cur)+1, re) END,
    CASE WHEN greatest(greatest(greatest(r.start_ms, rs), cur)+1, re) > end_ms THEN least(greatest(greatest(r.start_ms, rs), cur), greatest(start_ms, end_ms-1)) ELSE greatest(greatest(r.start_ms, rs), cur) END,
    CASE WHEN greatest(greatest(greatest(r.start_ms, rs), cur)+1, re) > end_ms THEN end_ms ELSE greatest(greatest(greatest(r.start_ms, rs), cur)+1, re) END
  FROM step p JOIN raw r ON r.episode_id=p.episode_id AND r.ord=p.ord AND r.i=p.i+1)
SELECT episode_id, ord, i AS pos, s, e FROM step WHERE i >= 0""")
def repaired_words(spark, sf):
    crooked = segments_with_words(spark, sf).withColumn("words", F.expr(
        "transform(words, (w, i) -> named_struct('t', w.t, 's', greatest(start_ms, w.s - CAST(i*37%250 AS BIGINT)), "
        "'e', greatest(w.s - CAST(i*37%250 AS BIGINT) + 1, w.e - CAST(i*91%500 AS BIGINT))))"))
    fixed = wd.repaired_words(crooked.select("episode_id", "ord", "words", "start_ms", "end_ms"))
    return fixed.select("episode_id", "ord", F.posexplode("words").alias("pos", "w")).select(
        "episode_id", "ord", F.col("pos").cast("long").alias("pos"), "w.s", "w.e")


@query("utterance_slot_bounds", "WITH " + TOK_SQL + """, g AS (SELECT episode_id, ord, i//20 AS utterance_no, min(s) AS s, max(e) AS e FROM tok GROUP BY ALL)
SELECT g.episode_id, g.ord, utterance_no, CASE WHEN utterance_no=0 THEN start_ms + 5 - 5 ELSE s+3 END AS start_ms,
  CASE WHEN utterance_no = max(utterance_no) OVER (PARTITION BY g.episode_id, g.ord) THEN end_ms ELSE e-3 END AS end_ms
FROM g JOIN segment s2 ON s2.episode_id=g.episode_id AND s2.ord=g.ord""")
def utterance_slot_bounds(spark, sf):
    seg = segments_with_words(spark, sf)
    utts = seg.select("episode_id", "ord", F.posexplode("words").alias("pos", "w")).groupBy(
        "episode_id", "ord", F.floor(F.col("pos") / 20).cast("long").alias("utterance_no")
    ).agg((F.min("w.s") + 3).alias("start_ms"), (F.max("w.e") - 3).alias("end_ms"))
    slots = view(spark, sf, "segment").selectExpr("episode_id", "ord", "start_ms AS slot_start", "end_ms AS slot_end")
    return wd.slot_bounds(utts.join(slots, ["episode_id", "ord"]), ["episode_id", "ord"]).select("episode_id", "ord", "utterance_no", "start_ms", "end_ms")


@query("nearby_dialogue", """SELECT episode_id, ord, substring(coalesce(array_to_string(list_concat(
   list(zh_text) OVER (PARTITION BY episode_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
   list(zh_text) OVER (PARTITION BY episode_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), ' / '), ''), 1, 600) AS nearby_text,
  array_to_string(list(speaker_id) OVER (PARTITION BY episode_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), ',') AS nearby_speakers FROM segment""")
def nearby_dialogue(spark, sf):
    out = cx.nearby_dialogue(view(spark, sf, "segment"), EP)
    return out.select("episode_id", "ord", "nearby_text",
                      F.array_join(F.transform("nearby", lambda r: r["speaker_id"]), ",").alias("nearby_speakers"))


@query("translation_batches", """SELECT episode_id, segment_id, (rn-1)//10 AS batch_no, (rn-1)%10 AS pos, 's' || CAST((rn-1)%10+1 AS VARCHAR) AS alias
 FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_ms, episode_id) AS rn FROM segment)""")
def translation_batches(spark, sf):
    out = cx.numbered_batches(view(spark, sf, "segment"), ["series_id"], ["start_ms", "episode_id"])
    return out.select("episode_id", "segment_id", "batch_no", "pos", "alias")


@query("token_budget_batches", """
WITH RECURSIVE l AS (SELECT episode_id, ord*3+5 AS ord, row_number() OVER (PARTITION BY episode_id ORDER BY ord) AS i, length(zh_text)*3 AS tokens FROM segment),
 j AS (SELECT *, CASE WHEN t1+t2+t3+t4 <= 4096 THEN 4 WHEN t1+t2+t3 <= 4096 THEN 3 WHEN t1+t2 <= 4096 THEN 2 ELSE 1 END AS k FROM (
   SELECT episode_id, ord, i, tokens AS t1, lead(tokens,1) OVER w AS t2, lead(tokens,2) OVER w AS t3, lead(tokens,3) OVER w AS t4 FROM l WINDOW w AS (PARTITION BY episode_id ORDER BY ord))),
 m AS (SELECT episode_id, ord, i, least(k, CASE WHEN t2 IS NULL THEN 1 WHEN t3 IS NULL THEN CASE WHEN t1+t2<=4096 THEN 2 ELSE 1 END
    WHEN t4 IS NULL THEN CASE WHEN t1+t2+t3<=4096 THEN 3 WHEN t1+t2<=4096 THEN 2 ELSE 1 END ELSE k END) AS k1,
    CASE WHEN t2 IS NULL THEN 1 WHEN t3 IS NULL THEN CASE WHEN t1+t2<=4096 THEN 2 ELSE 1 END
    WHEN t4 IS NULL THEN CASE WHEN t1+t2+t3<=4096 THEN 3 WHEN t1+t2<=4096 THEN 2 ELSE 1 END ELSE k END AS lines, t1,t2,t3,t4 FROM j),
 b AS (SELECT * FROM m WHERE i=1 UNION ALL SELECT m.* FROM b JOIN m ON m.episode_id=b.episode_id AND m.i=b.i+b.lines)
SELECT episode_id, ord AS first_ord, CAST(lines AS BIGINT) AS lines, t1 + CASE WHEN lines>1 THEN t2 ELSE 0 END + CASE WHEN lines>2 THEN t3 ELSE 0 END + CASE WHEN lines>3 THEN t4 ELSE 0 END AS tokens,
 (t1 + CASE WHEN lines>1 THEN t2 ELSE 0 END + CASE WHEN lines>2 THEN t3 ELSE 0 END + CASE WHEN lines>3 THEN t4 ELSE 0 END) > 4096 AS too_long FROM b""")
def token_budget_batches(spark, sf):
    lines = view(spark, sf, "segment").selectExpr("episode_id", "ord*3 + 5 AS ord", "CAST(length(zh_text)*3 AS BIGINT) AS tokens")
    return cx.packed_batches(lines, EP)


@query("text_scalars", r'''SELECT page_id, n1 AS normalized, length(replace(replace(replace(replace(html,'?',''),'!',''),'…',''),';','')) <> length(html) AS ends_sentence,
  length(replace(replace(html,',',''),':','')) <> length(html) AS ends_clause, regexp_matches(html, '[\p{P}\p{S}]') AS has_punctuation,
  sha256(u) AS units_hash FROM (SELECT page_id, html, regexp_replace(translate(nfc_normalize(html), @P@, repeat(' ',40)), '\s+', '', 'g') AS n1,
    replace(lower(regexp_replace(html, '[^\p{L}\p{N}]', '', 'g')),'ß','ss') AS u FROM pages)'''.replace("@P@", "'" + tx.COMPARE_PUNCTUATION.replace("'", "''") + "'"))
def text_scalars(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", tx.normalize_chinese(html).alias("normalized"), tx.ends_sentence(html).alias("ends_sentence"),
        tx.ends_clause(html).alias("ends_clause"), tx.has_punctuation(html).alias("has_punctuation"),
        F.sha2(tx.text_units(html), 256).alias("units_hash"))


@query("terminal_punctuation", """SELECT episode_id, ord, CASE WHEN m <> '' AND right(t,1) NOT IN ('.','!','?','…','。','！','？') THEN t || m ELSE t END AS text FROM (
  SELECT episode_id, ord, zh_text || CASE WHEN ord%2=0 THEN ' x' ELSE '' END AS t, CASE episode_id%5 WHEN 0 THEN '…' WHEN 1 THEN '' WHEN 2 THEN '!' WHEN 3 THEN '' ELSE '。' END AS m FROM segment)""")
def terminal_punctuation(spark, sf):
    lines = view(spark, sf, "segment").selectExpr(
        "episode_id", "ord", "concat(zh_text, CASE WHEN ord%2=0 THEN ' x' ELSE '' END) AS t",
        "CASE episode_id%5 WHEN 0 THEN ' ... ' WHEN 1 THEN ',' WHEN 2 THEN '!' WHEN 3 THEN '' ELSE '。' END AS raw")
    return lines.select("episode_id", "ord", tx.with_terminal(F.col("t"), tx.repaired_mark(F.col("raw"))).alias("text"))


@query("word_budget", "SELECT episode_id, ord, CAST(greatest(2, round_even((end_ms-start_ms)/1000.0::DOUBLE*5.5::DOUBLE, 0)) AS BIGINT) AS budget FROM segment")
def word_budget(spark, sf):
    return view(spark, sf, "segment").select("episode_id", "ord", tx.word_budget(F.col("end_ms") - F.col("start_ms")).alias("budget"))


@query("segment_ids", "SELECT episode_id, ord, segment_id FROM segment")
def segment_ids(spark, sf):
    return view(spark, sf, "segment").select("episode_id", "ord", tx.segment_id(F.col("start_ms"), F.col("ord")).alias("segment_id"))
