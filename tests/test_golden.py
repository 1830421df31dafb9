"""The measure against records that were scored elsewhere. GOLDEN_RECORDS names their folder; they are not part of this repository.

A record has prompts, outputs and level_metrics by level, and counterfactuals with prompt and output.
"""

import json
import math
import os
from pathlib import Path

import pytest

from inkgauge.functions.codecs import CODECS, pair_bits

FOLDER = os.environ.get("GOLDEN_RECORDS")


def ratios(prompt, output):
    """Ratio by codec, and that of the means over codecs."""
    bits = pair_bits(output, prompt)
    clamp = lambda own, given: min(1.0, max(0.0, (own - given) / own)) if own else 0.0
    own, given = (sum(b[i] for b in bits) / len(CODECS) for i in (1, 2))
    return {c: clamp(a, b) for c, a, b in bits} | {"all": clamp(own, given)}


@pytest.mark.skipif(FOLDER is None, reason="GOLDEN_RECORDS is not set")
def test_ratios_baselines_and_excess_of_scored_records():
    records = [json.loads(p.read_text(encoding="utf-8")) for p in sorted(Path(FOLDER).iterdir()) if p.suffix == ".json"]
    assert records
    for record in records:
        drawn = [ratios(c["prompt"], c["output"]) for c in record["counterfactuals"] if c["prompt"].strip() and c["output"].strip()]
        base = {k: math.fsum(d[k] for d in drawn) / len(drawn) if drawn else 0.0 for k in (*CODECS, "all")}
        for level, stored in record["level_metrics"].items():
            own = ratios(record["prompts"][level], record["outputs"][level])
            assert own["all"] == stored["actual_ratio"] and len(drawn) == stored["baseline_n_valid"]
            assert math.isclose(base["all"], stored["baseline_mean"], abs_tol=1e-12)
            assert math.isclose(own["all"] - base["all"], stored["excess_ratio"], abs_tol=1e-12)
            for codec in CODECS:
                assert own[codec] == stored["per_compressor"][codec]["actual_ratio"]
                assert math.isclose(base[codec], stored["per_compressor"][codec]["baseline_mean"], abs_tol=1e-12)
