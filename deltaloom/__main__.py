"""Command line for single pairs: make a patch, or apply one in place.

    python -m deltaloom [--encode] OLD NEW PATCH
    python -m deltaloom --decode IMAGE PATCH

Exit codes: 0 done, 1 the patch was refused, 2 wrong use or an input or output error.
"""

from __future__ import annotations

import os
import sys
import tempfile

from .codec.encode import encode
from .codec.patch import apply_patch
from .functions.bits import MAX_IMAGE


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_IMAGE:
        raise OSError(f"{path} is too large")
    with open(path, "rb") as f:
        return f.read()


def _replace(path: str, data: bytes) -> None:
    """Write beside ``path``, flush, keep its mode, and rename."""
    mode = os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644
    fd, draft = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fchmod(f.fileno(), mode)
            os.fsync(f.fileno())
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def main(args: list[str]) -> int:
    if args in (["--help"], ["-h"]):
        print(__doc__)
        return 0
    decode = args[:1] == ["--decode"]
    paths = args[1:] if args[:1] in (["--decode"], ["--encode"]) else args
    if len(paths) != (2 if decode else 3) or any(p.startswith("--") for p in paths):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        out, inputs = (paths[0], paths[1:]) if decode else (paths[2], paths[:2])
        if any(os.path.exists(out) and os.path.exists(p) and os.path.samefile(out, p) for p in inputs):
            print(f"{out} is also an input", file=sys.stderr)
            return 2
        if not decode:
            _replace(out, encode(_read(paths[0]), _read(paths[1])).blob)
            return 0
        done = apply_patch(_read(paths[0]), _read(paths[1]))
        if done.status != "NONE":
            print(f"refused ({done.status}): {done.why}", file=sys.stderr)
            return 1
        _replace(out, done.out)
        print(" ".join(f"{k}={v}" for k, v in done.counters.items()), file=sys.stderr)
        return 0
    except OSError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
