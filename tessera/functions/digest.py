"""Digests as identities, as orders and as draws."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA = r"^[0-9a-f]{64}$"


def sha(x) -> Column:
    return F.sha2(F.col(x) if isinstance(x, str) else x, 256)


def is_sha(x) -> Column:
    return F.coalesce(x.rlike(SHA), F.lit(False))


def joined_sha(*parts) -> Column:
    """Digest of the parts, a newline between them: the key of every deterministic order."""
    return sha(F.concat_ws("\n", *[F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts]))


def short_id(prefix: str, x) -> Column:
    return F.concat(F.lit(prefix), F.substring(sha(x), 1, 20))


def mod_pair(digest, width) -> Column:
    """Struct rest = digest % width and next = (digest // width) % width of a 256-bit digest, by Horner's rule modulo
    width squared; exact in 64 bits for widths up to 7e8."""
    square = width.cast("long") * width.cast("long")
    value = F.aggregate(F.transform(F.split(digest, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + d, square))
    return F.struct(F.pmod(value, width).alias("rest"), F.floor(value / width).cast("long").alias("next"))


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_sha(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def file_sha(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def folder_sha(root: str | Path) -> str:
    """One digest of all files below a folder: sorted lines of relative path, size and digest."""
    root = Path(root)
    lines = sorted(f"{p.relative_to(root).as_posix()}\0{p.stat().st_size}\0{file_sha(p)}\n" for p in root.rglob("*") if p.is_file())
    return hashlib.sha256("".join(lines).encode()).hexdigest()
