"""Parameters of indexing and alignment, and the hash coefficients drawn from them."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class AlignParams:
    """Names follow the command line: h sketch length, n_tables, proj_len, buckets_pow2, k index k-mer, w window, max_count
    frequent k-mers, min_hits, best_dist, k2 voting k-mer, delta convolution radius, delta_x distance of separate hits, cutoff,
    scale, interval sampling, bin_size, task_size contigs per key pair, mask_neighbours, batch reads per batch."""

    h: int = 128
    n_tables: int = 78
    proj_len: int = 2
    buckets_pow2: int = 18
    k: int = 16
    w: int = 150
    max_count: int = 800
    min_hits: int = 1
    best_dist: int = 20
    k2: int = 20
    delta: int = 10
    delta_x: int = 30
    cutoff: int = 0
    scale: int = 50
    interval: int = 1
    bin_size: int = 1
    task_size: int = 1
    mask_neighbours: bool = False
    batch: int = 100_000
    bucket_cap: int = 1000
    contig_cap: int = 100_000
    contigs_threshold: int = 10_000
    exclude: int = 50
    seed: int = 1

    def __post_init__(self) -> None:
        if not 0 < self.k <= 16 or not 0 < self.k2 <= 32:
            raise ValueError("k must be at most 16 and k2 at most 32")
        if self.interval < 1 or self.bin_size < 1 or (self.bin_size > 1 and self.interval > self.bin_size):
            raise ValueError("interval must be at least 1 and no larger than bin_size")
        if self.w < self.k or self.n_tables > 1024 or self.proj_len > self.h:
            raise ValueError("window shorter than k, more than 1024 tables or projections longer than sketches")

    @classmethod
    def documented(cls) -> AlignParams:
        """The values that the reference documents where they differ from its code."""
        return cls(delta_x=40, interval=3, bin_size=20)

    def vanilla(self) -> AlignParams:
        """No keys and no masking: bins of one, all contigs in one task."""
        return replace(self, bin_size=1, task_size=1 << 30, mask_neighbours=False)

    @property
    def name(self) -> str:
        """Folder name of what is stored for these parameters."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def minhash_coefficients(self) -> list[int]:
        r = random.Random(self.seed)
        return [r.randrange(1 << 30) * 2 + 1 for _ in range(self.h)]

    def projections(self) -> list[list[int]]:
        """Sketch coordinates of each table, without repetition within a table."""
        r = random.Random(self.seed + 1)
        return [r.sample(range(self.h), self.proj_len) for _ in range(self.n_tables)]

    def projection_coefficients(self) -> list[int]:
        r = random.Random(self.seed + 2)
        return [r.randrange(1 << 31) * 2 + 1 for _ in range(self.proj_len)]

    def bin_order(self) -> list[int]:
        order = list(range(self.bin_size))
        random.Random(self.seed + 3).shuffle(order)
        return order
