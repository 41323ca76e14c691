"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import voxtable.plans  # noqa: E402
from voxtable.plans.registry import QUERIES  # noqa: E402
from voxtable.session import local_session  # noqa: E402

HEADLINE = (
    "dubbed_cues", "coalesce_padded_spans", "speech_window_union", "separation_windows", "silence_sessions",
    "speaker_overlap_pairs", "protected_collisions", "uncovered_words", "chunk_word_ownership", "sample_grid",
    "alignment_group_verdicts", "utterances", "character_error_rate", "nearby_dialogue", "token_budget_batches",
    "strict_subtitle_cues", "corpus_case_violations", "glossary_evidence", "translations_accepted", "queue_order",
    "illegal_transitions", "upload_first_rejected", "run_report", "suite_rollup", "artifact_digest", "subtitle_band",
    "audio_quality", "three_stem_mix",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    voxtable.plans.load()
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in only:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
