"""Command line: `python -m inkgauge score --prompt TEXT --output TEXT` or `--session FILE`, and `python -m inkgauge query NAME TABLES`.

A session file is JSON with prompt, output and, optionally, counterfactuals (prompt, output) and conversation (role, content).
"""

from __future__ import annotations

import argparse
import json
import math
import re
import sys

from inkgauge.functions.codecs import CODECS, pair_bits
from inkgauge.operators.geometry import guidance, trajectory


def gain(prompt: str, output: str) -> dict[str, float]:
    """self_bits, gain, ratio and gain_per_token of one pair."""
    bits = pair_bits(output, prompt)
    own, given = (sum(b[i] for b in bits) / len(CODECS) for i in (1, 2))
    won, tokens = max(0.0, own - given), len(re.findall(r"\w+|[^\w\s]", output))
    return {"self_bits": own, "gain": won, "ratio": min(1.0, won / own) if own else 0.0, "gain_per_token": won / tokens if tokens else 0.0}


def session(record: dict) -> dict:
    """Scores of one session: the pair, the mean of its valid counterfactuals, the excess, and the composite."""
    actual = gain(record.get("prompt") or "", record.get("output") or "")
    pairs = [(c.get("prompt") or "", c.get("output") or "") for c in record.get("counterfactuals") or []]
    drawn = [gain(p, o) for p, o in pairs if p.strip() and o.strip()]
    base = {k: math.fsum(d[k] for d in drawn) / len(drawn) if drawn else 0.0 for k in ("gain", "ratio", "gain_per_token")}
    turns = record.get("conversation") or []
    texts = [t.get("content") or "" for t in turns]
    path = trajectory(texts)[-1] if sum(bool(t.strip()) for t in texts) >= 2 else 0.0
    exchange, asked = [], None
    for turn in turns:
        role, content = (turn.get("role") or "").lower(), turn.get("content")
        if role in ("user", "human"):
            exchange += [(asked, None)] if asked is not None else []
            asked = content
        elif role in ("assistant", "ai", "model"):
            exchange.append((asked, content))
            asked = None
    led = guidance(exchange) if exchange else 0.0
    clamp = lambda x: min(1.0, max(0.0, x))
    excess = actual["ratio"] - base["ratio"]
    composite = clamp(0.45 * actual["ratio"] + 0.45 * clamp(excess) + 0.10 * clamp(max(path, led)))
    return {"actual": actual, "baseline": base, "counterfactuals": len(drawn), "excess": excess, "guidance": led, "trajectory": path, "composite": composite}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="inkgauge")
    commands = parser.add_subparsers(dest="command", required=True)
    score = commands.add_parser("score", help="scores of one session as JSON")
    score.add_argument("--session")
    score.add_argument("--prompt", default="")
    score.add_argument("--output", default="")
    run = commands.add_parser("query", help="runs a query and shows rows or writes them as Parquet")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--to")
    given = parser.parse_args(argv)
    if given.command == "score":
        if given.session:
            with open(given.session, encoding="utf-8") as file:
                record = json.load(file)
        else:
            record = {"prompt": given.prompt, "output": given.output}
        json.dump(session(record), sys.stdout, sort_keys=True)
        print()
        return
    from inkgauge.plans import catalog
    from inkgauge.session import build_session

    df = catalog.queries()[given.name](build_session(), given.tables)
    df.write.parquet(given.to) if given.to else df.show(truncate=False)


if __name__ == "__main__":
    main()
