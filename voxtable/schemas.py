"""Declared schemas: the driver's tables and the dubbing documents. Nothing is inferred."""

from __future__ import annotations

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

WORD = "struct<t:string,s:bigint,e:bigint>"
RAW_WORD = "struct<word:string,start:double,end:double,score:double>"
ROI = "struct<x:double,y:double,w:double,h:double>"

SEGMENT = (
    f"episode_id bigint, segment_id string, start_ms bigint, end_ms bigint, zh_text string, "
    f"words array<{WORD}>, subtitle_vi string, dub_vi string, speaker_id string, track_id string, "
    "character_id string, addressee_id string, addressing map<string,string>, action string, "
    "speech_kind string, needs_review boolean, confidence map<string,double>"
)
# One JSON document per finished stage.
ARTIFACT_DOC = (
    "schema_version int, source_sha256 string, "
    f"segments array<struct<id:string,start_ms:bigint,end_ms:bigint,zh_text:string,words:array<{WORD}>,"
    "action:string,needs_review:boolean>>, "
    "frames array<struct<at_ms:bigint,lines:array<struct<text:string,score:double,box:array<array<double>>>>>>, "
    "turns array<struct<start_ms:bigint,end_ms:bigint,speaker_id:string,track_id:string>>"
)
CORPUS_DOC = (
    "schema_version int, kind string, cases array<struct<id:string,source:string,source_sha256:string,"
    f"start_ms:bigint,end_ms:bigint,category:string,zh_reference:string,words:array<{WORD}>,roi:{ROI},"
    "tts_text:string,target_ms:bigint>>"
)
REPORT_DOC = (
    "schema_version int, stage string, status string, source_sha256 string, source_duration_ms bigint, "
    "metrics map<string,double>, quality_evidence_missing array<string>, model_revision string, weights_sha256 string"
)
PROBE_DOC = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,"
    "sample_rate:string,channels:int,duration:string,disposition:struct<attached_pic:int>>>, "
    "format struct<duration:string,format_name:string>"
)
