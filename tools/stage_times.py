"""Stage timings from a Spark event log (no UI): slowest stages with their task counts.

usage: python tools/stage_times.py EVENT_LOG_DIR_OR_FILE [top_n]
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _open(f):
    """Event logs are zstd-compressed by default in Spark 4 (zstandard is in the image)."""
    import io
    if f.endswith(".zstd"):
        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
    return open(f, encoding="utf-8", errors="replace")


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    files = [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True))
    stages = []
    for f in files:
        if not os.path.isfile(f):
            continue
        with _open(f) as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                if ev.get("Event") == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    sub, done = info.get("Submission Time"), info.get("Completion Time")
                    if sub and done:
                        stages.append((done - sub, info["Stage ID"], info["Number of Tasks"], info["Stage Name"][:90]))
    total = sum(s[0] for s in stages)
    print(f"{len(stages)} stages, {total / 1000:.1f} s of stage wall time")
    for ms, sid, n, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms / 1000:7.2f} s  stage {sid:4d}  tasks {n:4d}  {name}")


if __name__ == "__main__":
    main()
