"""Per-stage durations from a Spark event log (JSON lines).

    python scripts/stage_times.py <event-log-dir-or-file> [top_n]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    # Spark 4 writes rolling logs: eventlog_v2_<app>/events_<n>_<app> files
    files = [path] if os.path.isfile(path) else sorted(
        f for f in glob.glob(os.path.join(path, "**", "*"), recursive=True)
        if os.path.isfile(f) and not f.endswith(".inprogress") and "appstatus" not in os.path.basename(f))
    stages = []
    for f in files:
        with open(f) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    if "Completion Time" in info and "Submission Time" in info:
                        stages.append(((info["Completion Time"] - info["Submission Time"]) / 1000.0,
                                       info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:90]))
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {sum(s[0] for s in stages):.1f} s total")
    for sec, sid, ntask, name in stages[:top]:
        print(f"{sec:8.2f}s  stage {sid:5d}  tasks {ntask:5d}  {name}")


if __name__ == "__main__":
    main()
