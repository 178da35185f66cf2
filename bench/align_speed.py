"""Pairs aligned per second by one process: identical, 70 % alike and unlike pairs. ``python -m bench.align_speed [pairs] [size]``."""

import sys
import time

import numpy as np

from vellum.operators.align import ROWS, align_batch
from vellum.params import Params


def main(pairs: int = 640, size: int = 275) -> None:
    rng, base = np.random.default_rng(1), np.arange(size)
    kinds = {"identical": lambda: base, "70 % alike": lambda: np.where(rng.random(size) < 0.7, base, base + 100_000), "unlike": lambda: base + 100_000}
    zero = np.zeros(size, np.int64)
    for name, other in kinds.items():
        b = [other() for _ in range(pairs)]
        began = time.time()
        for k in range(0, pairs, ROWS):
            n = len(b[k : k + ROWS])
            align_batch([base] * n, b[k : k + ROWS], [zero] * n, [zero] * n, None, None, Params())
        print(f"{name}: {pairs / (time.time() - began):.0f} pairs/s")


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
