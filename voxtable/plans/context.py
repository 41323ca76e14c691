"""Glossary, translation-batch, context and cue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.functions import text as tx
from voxtable.operators import catalog as ct
from voxtable.operators import context as cx
from voxtable.operators import rules as rl
from voxtable.operators import subtitles as st
from voxtable.plans.registry import query
from voxtable.plans.views import table, view

EP = ["episode_id"]


@query("glossary_evidence", "SELECT d.doc_id, g.updated_at AS term_id, g.vi FROM documents d JOIN glossary g ON contains(d.text, g.term)")
def glossary_evidence(spark, sf):
    terms = view(spark, sf, "glossary").selectExpr("updated_at AS term_id", "term", "vi")
    lines = table(spark, sf, "documents").select("doc_id", "text")
    return cx.term_matches(lines, terms, [], text="text", term="term").select("doc_id", "term_id", "vi")


BATCH = "b AS (SELECT *, ord//4 AS batch_no FROM segment)"


@query("relevant_glossary", "WITH " + BATCH + """ SELECT DISTINCT b.series_id, b.episode_id, batch_no, g.zh FROM b JOIN (SELECT series_id, zh FROM glossary) g ON b.series_id=g.series_id AND contains(b.zh_text, g.zh)""")
def relevant_glossary(spark, sf):
    lines = view(spark, sf, "segment").withColumn("batch_no", F.expr("ord DIV 4"))
    return cx.relevant_terms(lines, view(spark, sf, "glossary").select("series_id", "zh"), ["series_id"], ["episode_id", "batch_no"], text="zh_text", term="zh")


@query("locked_term_rejects", "WITH " + BATCH + """ SELECT b.series_id, b.episode_id, batch_no, count(*) AS omissions FROM b JOIN glossary g ON b.series_id=g.series_id AND g.locked AND contains(b.zh_text, g.zh)
 WHERE ord%11=5 OR ord%13=7 OR NOT contains(replace(lower(b.zh_text),'ß','ss'), replace(lower(g.vi),'ß','ss')) OR NOT contains(replace(lower(upper(b.zh_text)),'ß','ss'), replace(lower(g.vi),'ß','ss')) GROUP BY ALL""")
def locked_term_rejects(spark, sf):
    # Some lines came back without a subtitle, some without a dubbing text.
    lines = view(spark, sf, "segment").withColumns({
        "batch_no": F.expr("ord DIV 4"), "sub": F.expr("CASE WHEN ord%11 <> 5 THEN zh_text END"), "dub": F.expr("CASE WHEN ord%13 <> 7 THEN upper(zh_text) END")})
    terms = view(spark, sf, "glossary").where("locked").select("series_id", "zh", "vi")
    return cx.locked_term_rejects(lines, terms, ["series_id"], ["episode_id", "batch_no"], source="zh_text", subtitle="sub", dub="dub", term="zh", target="vi")


@query("speaker_characters", """SELECT episode_id, ord, CASE WHEN speaker_id<>'system' AND episode_id%4<>0 THEN 'char_' || speaker_id END AS character_id,
  (speaker_id='system' OR episode_id%4=0 OR ord%3=0) AS uncertain FROM segment""")
def speaker_characters(spark, sf):
    lines = view(spark, sf, "segment").withColumn("addressee_id", F.expr("CASE WHEN ord%3<>0 THEN 'x' END"))
    speakers = lines.where("speaker_id <> 'system' AND episode_id%4 <> 0").select(
        "episode_id", "speaker_id", F.concat(F.lit("char_"), "speaker_id").alias("character_id")).distinct()
    return cx.with_characters(lines, speakers, EP).select("episode_id", "ord", "character_id", "uncertain")


def batched(spark, sf):
    lines = view(spark, sf, "segment").withColumn("batch_no", F.expr("ord DIV 4"))
    return lines.withColumn("pos", F.expr("ord % 4")).withColumn("alias", F.concat(F.lit("s"), (F.col("pos") + 1).cast("string")))


def responses(spark, sf):
    """Model replies with planted faults by episode; most use the short aliases."""
    item = F.struct(
        F.expr("CASE WHEN episode_id%11=4 THEN segment_id WHEN episode_id%11=5 AND pos=1 THEN 's1' ELSE alias END").alias("id"),
        F.concat(F.lit(" "), F.regexp_replace("zh_text", r"(?s).*\s", "")).alias("subtitle_vi"),
        F.expr("CASE WHEN episode_id%11=6 AND pos=0 THEN ' ' ELSE 'dub' END").alias("dub_vi"),
        F.lit("calm").alias("emotion"),
        F.expr("CASE pos WHEN 0 THEN '...' WHEN 1 THEN ',' ELSE '!' END").alias("punctuation"))
    rows = batched(spark, sf).where("NOT (episode_id%11=7 AND pos=0) AND NOT (episode_id%11=10)")
    body = F.to_json(F.struct(F.collect_list(item).alias("segments")))
    faulty = F.when(F.expr("episode_id%11=8"), F.lit("not json")).when(
        F.expr("episode_id%11=9"), F.replace(F.col("body"), F.lit('"emotion":"calm"'), F.lit('"emotion":7'))).otherwise(F.col("body"))
    return rows.groupBy("episode_id", "batch_no").agg(body.alias("body")).withColumn("body", faulty)


REPLY_SQL = """b AS (SELECT *, ord//4 AS batch_no, ord%4 AS pos FROM segment),
 k AS (SELECT episode_id, batch_no, count(*) AS n, CASE WHEN episode_id%11=10 THEN 'NO_RESPONSE' WHEN episode_id%11 IN (8, 9) THEN 'INVALID_SHAPE' WHEN episode_id%11=5 AND count(*) > 1 THEN 'DUPLICATE_ID'
   WHEN episode_id%11=6 THEN 'EMPTY_TEXT' WHEN episode_id%11=7 AND count(*)=1 THEN 'NO_RESPONSE' WHEN episode_id%11=7 THEN 'IDS_DO_NOT_MATCH' END AS reason FROM b GROUP BY episode_id, batch_no)"""


@query("translation_rejects", "WITH " + REPLY_SQL + " SELECT episode_id, batch_no, reason FROM k WHERE reason IS NOT NULL")
def translation_rejects(spark, sf):
    return cx.matched_translations(batched(spark, sf), responses(spark, sf), ["episode_id", "batch_no"])[1]


@query("translations_accepted", "WITH " + REPLY_SQL + r""", a AS (SELECT b.episode_id, b.segment_id, b.pos, regexp_extract(zh_text, '([^\s]*)$', 1) AS sub FROM b JOIN k USING (episode_id, batch_no) WHERE reason IS NULL)
 SELECT episode_id, segment_id, CASE WHEN pos=1 OR right(sub,1) IN ('.','!','?','…','。','！','？') THEN sub ELSE sub || CASE WHEN pos=0 THEN '…' ELSE '!' END END AS subtitle_vi,
  CASE pos WHEN 1 THEN 'dub' WHEN 0 THEN 'dub…' ELSE 'dub!' END AS dub_vi, 'calm' AS emotion FROM a""")
def translations_accepted(spark, sf):
    good = cx.matched_translations(batched(spark, sf), responses(spark, sf), ["episode_id", "batch_no"])[0]
    return good.select("episode_id", "segment_id", "subtitle_vi", "dub_vi", "emotion")


@query("rejected_batches_kept", "WITH " + REPLY_SQL + " SELECT b.episode_id, b.ord, 'KEEP' AS action, true AS needs_review FROM b JOIN k USING (episode_id, batch_no) WHERE reason IS NOT NULL")
def rejected_batches_kept(spark, sf):
    lines = batched(spark, sf)
    bad = cx.matched_translations(lines, responses(spark, sf), ["episode_id", "batch_no"])[1]
    return cx.kept_originals(lines, bad, ["episode_id", "batch_no"]).select("episode_id", "ord", "action", "needs_review")


@query("context_proposals", """SELECT episode_id, ord, (ord%5<>1 AND speaker_id<>'system' AND ord%7<>3) AS accepted, true AS known_line FROM segment
 UNION ALL SELECT episode_id, NULL, false, false FROM segment WHERE ord%4=0 UNION ALL SELECT episode_id, NULL, false, false FROM segment WHERE ord%4=1""")
def context_proposals(spark, sf):
    lines = batched(spark, sf)
    known = table(spark, sf, "conversations").where("role <> 'system'").selectExpr("conv_id%7 AS series_id", "role AS character_id").distinct()
    offers = lines.selectExpr(
        "series_id", "episode_id", "batch_no", "alias", "speaker_id AS character_id", "CAST(NULL AS STRING) AS addressee_id",
        "CASE WHEN ord%7=3 THEN map('they', 'x') ELSE map('self', 'toi') END AS addressing",
        "CASE WHEN ord%5=1 THEN '' ELSE substring_index(zh_text, ' ', 2) END AS evidence")
    # Proposals for a line that the batch does not have, and for a batch that has no lines.
    first, second = (offers.where(f"alias = '{a}'") for a in ("s1", "s2"))
    offers = offers.unionByName(first.withColumn("alias", F.lit("s99"))).unionByName(second.withColumn("batch_no", F.lit(-1).cast("long")))
    out = cx.context_proposals(offers, lines.select("episode_id", "batch_no", "alias", "segment_id", "zh_text", "ord"), known, ["episode_id", "batch_no"])
    ids = lines.select("episode_id", "segment_id", "ord")
    return out.join(ids, ["episode_id", "segment_id"], "left").select("episode_id", "ord", "accepted", "known_line")


@query("context_hashes", r"""SELECT episode_id, ord, sha256('{"glossary_version":' || CAST(ord%3 AS VARCHAR) || ',"nearby_context":"' || n || '","series_id":"' || CAST(series_id AS VARCHAR) || '","source":"' || s || '"}') AS hash
 FROM (SELECT *, replace(replace(trim(regexp_replace(nfc_normalize(zh_text), '\s+', ' ', 'g')), '\', '\\'), '"', '\"') AS s,
   replace(replace(trim(regexp_replace(nfc_normalize(speaker_id || '  ' || zh_text || chr(10)), '\s+', ' ', 'g')), '\', '\\'), '"', '\"') AS n FROM segment)""")
def context_hashes(spark, sf):
    lines = view(spark, sf, "segment").withColumn("nearby", F.concat("speaker_id", F.lit("  "), "zh_text", F.lit("\n")))
    keyed = lines.withColumn("s", tx.context_key(F.col("zh_text"))).withColumn("n", tx.context_key(F.col("nearby")))
    return keyed.select("episode_id", "ord", tx.context_hash(F.col("series_id").cast("string"), F.col("s"), F.col("n"), F.col("ord") % 3).alias("hash"))


TM = """rq AS (SELECT series_id, sha256(zh_text) AS source_hash, sha256(speaker_id) AS context_hash, episode_id, ord FROM segment),
 tm AS (SELECT DISTINCT series_id, source_hash, context_hash FROM rq WHERE ord%3=0)"""


def _memory(spark, sf):
    req = view(spark, sf, "segment").select("series_id", F.sha2("zh_text", 256).alias("source_hash"), F.sha2("speaker_id", 256).alias("context_hash"), "episode_id", "ord")
    return req, req.where("ord%3 = 0").select("series_id", "source_hash", "context_hash").distinct().withColumn("result", F.lit("known"))


@query("translation_memory_hits", "WITH " + TM + " SELECT episode_id, ord, 'known' AS result FROM rq JOIN tm USING (series_id, source_hash, context_hash)")
def translation_memory_hits(spark, sf):
    return cx.memory_lookup(*_memory(spark, sf), ["series_id", "source_hash", "context_hash"])[0].select("episode_id", "ord", "result")


@query("translation_memory_misses", "WITH " + TM + " SELECT episode_id, ord FROM rq WHERE (series_id, source_hash, context_hash) NOT IN (SELECT (series_id, source_hash, context_hash) FROM tm)")
def translation_memory_misses(spark, sf):
    return cx.memory_lookup(*_memory(spark, sf), ["series_id", "source_hash", "context_hash"])[1].select("episode_id", "ord")


@query("api_usage", """SELECT episode_id, count(*) AS calls, CAST(sum(length(zh_text)) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN ord%3<>1 THEN ord END) AS BIGINT) AS completion_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM segment GROUP BY episode_id""")
def api_usage(spark, sf):
    calls = view(spark, sf, "segment").select("episode_id", F.format_string(
        '{"prompt_tokens":%d,"completion_tokens":%s,"total_tokens":true}', F.char_length("zh_text"),
        F.expr("CASE WHEN ord%3=1 THEN '\"7\"' ELSE CAST(ord AS STRING) END")).alias("usage"))
    return cx.usage_totals(calls, EP)


@query("strict_reply_decode", "SELECT page_id, page_id%4=0 AS exact FROM pages")
def strict_reply_decode(spark, sf):
    doc = F.expr("""CASE page_id%4 WHEN 0 THEN to_json(named_struct('id', url, 'text', html)) WHEN 1 THEN to_json(named_struct('id', url, 'text', html, 'extra', 1))
        WHEN 2 THEN to_json(named_struct('id', page_id, 'text', html)) ELSE html END""")
    return table(spark, sf, "pages").select("page_id", tx.strict_object(doc, {"id": "STRING", "text": "STRING"}).alias("exact"))


@query("addressing_history", """SELECT series_id, episode_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ord DESC, episode_id DESC) AS r FROM segment WHERE speaker_id<>'system') WHERE r <= 200""")
def addressing_history(spark, sf):
    rows = view(spark, sf, "segment").where("speaker_id <> 'system'").select("series_id", "episode_id", "ord")
    return ct.capped_history(rows.where("ord < 2"), rows.where("ord >= 2"), ["series_id"], ["ord", "episode_id"], 200)


MEM = """l AS (SELECT series_id, episode_id AS run_no, start_ms, segment_id, zh_text, CASE WHEN speaker_id<>'system' THEN speaker_id END AS character_id, CASE WHEN ord%3<>0 THEN 'x' END AS addressee_id FROM segment)"""


def memory_lines(spark, sf):
    return view(spark, sf, "segment").selectExpr(
        "series_id", "episode_id AS run_no", "start_ms", "segment_id", "zh_text", "'' AS subtitle_vi", "CASE WHEN speaker_id<>'system' THEN speaker_id END AS character_id",
        "CASE WHEN ord%3<>0 THEN 'x' END AS addressee_id", "map('self', 'toi') AS addressing")


@query("series_memory_history", "WITH " + MEM + """ SELECT series_id, run_no, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY run_no DESC, start_ms DESC, segment_id DESC) AS r FROM l WHERE character_id IS NOT NULL AND addressee_id IS NOT NULL) WHERE r <= 200""")
def series_memory_history(spark, sf):
    lines = memory_lines(spark, sf)
    old = lines.where("run_no%2 = 0 AND character_id IS NOT NULL AND addressee_id IS NOT NULL").selectExpr(
        "series_id", "run_no", "start_ms", "segment_id", "character_id AS speaker", "addressee_id AS addressee", "addressing")
    return ct.series_memory(old, lines.where("run_no%2 = 1"))[0].select("series_id", "run_no", "segment_id")


@query("series_memory_last_lines", "WITH " + MEM + """ SELECT series_id, run_no, segment_id, zh_text FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY run_no DESC, start_ms DESC, segment_id DESC) AS r FROM l) WHERE r <= 30""")
def series_memory_last_lines(spark, sf):
    lines = memory_lines(spark, sf)
    none = lines.selectExpr("series_id", "run_no", "start_ms", "segment_id", "character_id AS speaker", "addressee_id AS addressee", "addressing").limit(0)
    return ct.series_memory(none, lines)[1].select("series_id", "run_no", "segment_id", "zh_text")


@query("translation_input_violations", """SELECT episode_id, lid AS line_id, 'BLANK_SOURCE_TEXT' AS code FROM (SELECT episode_id, ord//2 AS lid, ord FROM segment) WHERE (episode_id+ord)%9=2
UNION ALL SELECT episode_id, ord//2, 'DUPLICATE_ID' FROM segment GROUP BY ALL HAVING count(*) > 1""")
def translation_input_violations(spark, sf):
    lines = view(spark, sf, "segment").selectExpr("episode_id", "ord DIV 2 AS line_id", "CASE WHEN (episode_id+ord)%9=2 THEN ' \n' ELSE zh_text END AS zh_text")
    return rl.translation_input_rules(lines, EP, "line_id")


CUE_SRC = """src AS (SELECT series_id, episode_id, ord, start_ms + CASE WHEN ord%5=4 THEN -20000000 ELSE 0 END AS start_ms, end_ms, CASE WHEN ord%3=0 THEN '' WHEN ord%4=1 THEN '<i>{' || zh_text || '} & ' ELSE zh_text END AS subtitle_vi,
   CASE WHEN ord=0 THEN '   ' ELSE 'dub ' || zh_text END AS dub_vi, CAST(100000 AS BIGINT) AS duration_ms FROM segment)"""


def cue_source(spark, sf):
    return view(spark, sf, "segment").selectExpr(
        "series_id", "episode_id", "ord", "start_ms + CASE WHEN ord%5=4 THEN -20000000 ELSE 0 END AS start_ms", "end_ms",
        "CASE WHEN ord%3=0 THEN '' WHEN ord%4=1 THEN concat('<i>{', zh_text, '} & ') ELSE zh_text END AS subtitle_vi",
        "CASE WHEN ord=0 THEN '   ' ELSE concat('dub ', zh_text) END AS dub_vi", "100000L AS duration_ms")


STAMP = "printf('%02d:%02d:%02d,%03d', {0}//3600000, {0}//60000%60, {0}//1000%60, {0}%1000)"
CLEAN = "replace(replace(replace(replace(replace({0}, '{{', '｛'), '}}', '｝'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("strict_subtitle_cues", "WITH " + CUE_SRC + r""", w AS (SELECT series_id, least(start_ms, duration_ms) AS s, least(end_ms, duration_ms) AS e, regexp_replace(CASE WHEN subtitle_vi='' THEN dub_vi ELSE subtitle_vi END, '^\s+|\s+$', '', 'g') AS t, row_number() OVER () AS rid FROM src WHERE start_ms >= 0 AND end_ms > start_ms),
 l AS (SELECT rid, """ + CLEAN.format("trim(x)") + """ AS x, i FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM w)),
 j AS (SELECT series_id, s, e, (SELECT string_agg(x, chr(10) ORDER BY i) FROM l WHERE l.rid=w.rid AND x <> '') AS text FROM w WHERE e > s),
 n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY s, e, text) AS cue_no FROM j WHERE text <> '')
SELECT series_id, cue_no, CAST(cue_no AS VARCHAR) || chr(10) || """ + STAMP.format("s") + " || ' --> ' || " + STAMP.format("e") + " || chr(10) || text AS block FROM n")
def strict_subtitle_cues(spark, sf):
    return st.strict_cues(cue_source(spark, sf), ["series_id"])[0].select("series_id", "cue_no", "block")


@query("subtitle_cue_errors", "WITH " + CUE_SRC + " SELECT episode_id, ord, 'INVALID_CUE_BOUNDS' AS error FROM src WHERE start_ms < 0 OR end_ms <= start_ms")
def subtitle_cue_errors(spark, sf):
    return st.strict_cues(cue_source(spark, sf), ["series_id"])[1].select("episode_id", "ord", "error")


@query("plain_subtitle_cues", r"""WITH n AS (SELECT episode_id, start_ms, end_ms, translate(zh_text, chr(10) || chr(13), '  ') AS text, row_number() OVER (PARTITION BY episode_id ORDER BY ord) AS cue_no FROM segment WHERE ord%4<>2)
SELECT episode_id, cue_no, CAST(cue_no AS VARCHAR) || chr(10) || """ + STAMP.format("start_ms") + " || ' --> ' || " + STAMP.format("end_ms") + " || chr(10) || text AS block FROM n")
def plain_subtitle_cues(spark, sf):
    lines = view(spark, sf, "segment").withColumn("subtitle_vi", F.expr("CASE WHEN ord%4=2 THEN '  ' ELSE zh_text END"))
    return st.plain_cues(lines, EP, ["ord"]).select("episode_id", "cue_no", "block")
