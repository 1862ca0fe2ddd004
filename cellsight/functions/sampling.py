"""Hash-based uniforms: the same row gets the same draw under any partitioning and in any engine."""

from __future__ import annotations


def uniform(key: str, seed: str | int) -> str:
    """SQL for a number in [0, 1) from a key column and a seed."""
    return f"CAST(conv(substr(md5(concat(CAST({key} AS STRING), '|{seed}')), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"


def shuffle_key(key: str, seed: str | int) -> str:
    """SQL for a text that orders rows at random but reproducibly."""
    return f"md5(concat(CAST({key} AS STRING), '|{seed}'))"
