"""Print the slowest stages of the jobs after a marker job description, from a Spark event
log directory (written with spark.eventLog.enabled=true to a scratch folder).

usage: python tools/stage_times.py <eventlog dir> [marker]
"""

from __future__ import annotations

import glob
import io
import json
import sys


def lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    root, marker = sys.argv[1], (sys.argv[2] if len(sys.argv) > 2 else "TIMED")
    files = sorted(glob.glob(f"{root}/**/events_*", recursive=True)) or sorted(glob.glob(f"{root}/*"))
    desc, stages, started = {}, {}, False
    for f in files:
        for line in lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                p = e.get("Properties") or {}
                started = started or p.get("spark.job.description") == marker
                if started:
                    for s in e["Stage Infos"]:
                        rdds = ",".join(sorted({r.get("Scope", "{}")[:0] + r["Name"] for r in s.get("RDD Info", [])}))
                        desc[s["Stage ID"]] = (e["Job ID"], rdds[:160])
            elif ev == "SparkListenerStageCompleted" and started:
                si = e["Stage Info"]
                if si["Stage ID"] in desc and "Submission Time" in si:
                    stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"], si["Number of Tasks"])
    print("stages", len(stages), "sum ms", sum(d for d, _ in stages.values()))
    for sid, (d, n) in sorted(stages.items(), key=lambda x: -x[1][0])[:int(sys.argv[3]) if len(sys.argv) > 3 else 20]:
        print(f"stage {sid}: {d} ms, {n} tasks, job/rdds {desc[sid]}")


if __name__ == "__main__":
    main()
