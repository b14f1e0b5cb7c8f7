"""A queue that forgets what it hands out: files of a folder, each taken once."""

import json
from pathlib import Path


def put(folder, jobs):
    at = len(list(Path(folder).iterdir()))
    for i, job in enumerate(jobs):
        Path(folder, f"{at + i:06d}").write_text(json.dumps(job))


def poll(options):
    for path in sorted(Path(options["waiting"]).iterdir()):
        if not path.name.endswith(".taken"):
            path.rename(f"{path}.taken")
            return json.loads(Path(f"{path}.taken").read_text())
    return None
