"""Engine parameters in one place, with the command-line options that set them."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults follow the usual build: 32-bit numbers, 32 parts, 8 kept results, 4 lanes, 1024 columns."""

    matrix: str = ""
    debug: bool = False
    use_sample: bool = False
    reset: bool = True
    iterations: int = 1
    ignore_values: bool = False
    k: int = 100
    width: int = 32
    parts: int = 32
    keep: int = 8
    lanes: int = 4
    half: bool = False
    zero_indexed: bool = False
    blocks: int = 0
    impl: str = "approximate"

    @property
    def packet(self) -> int:
        """Entries of one 512-bit packet: a column has 10 bits, a row count 4, one bit marks a new row."""
        return (512 - 1) // (self.width + 10 + 4)


#: What ``impl`` names: a search of the index.
IMPLEMENTATIONS = ("exact", "approximate")


def parse(argv: Sequence[str]) -> Params:
    """Params from command-line options."""
    p = argparse.ArgumentParser()
    # fixed values: the usual option letters
    p.add_argument("-m", "--matrix", default="", help="Matrix-Market file; a random matrix if none is given")
    p.add_argument("-d", "--debug", action="store_true", help="print every run")
    p.add_argument("-s", "--use-sample", action="store_true", help="a small random matrix")
    p.add_argument("-r", "--no-reset", dest="reset", action="store_false", help="one query for all iterations")
    p.add_argument("-t", "--iterations", type=int, default=1)
    p.add_argument("-x", "--zero-indexed", action="store_true", help="the file counts from 0")
    p.add_argument("-v", "--ignore-values", action="store_true", help="all entries 1")
    p.add_argument("-k", "--k", type=int, default=100)
    p.add_argument("-b", "--blocks", type=int, default=0, help="shuffle partitions; 0: as the session has them")
    p.add_argument("-c", "--parts", type=int, default=32, help="row parts of the approximate search")
    p.add_argument("-g", "--keep", type=int, default=8, help="results kept of each part")
    p.add_argument("-i", "--impl", choices=IMPLEMENTATIONS, default="approximate")
    p.add_argument("-a", "--half", action="store_true", help="values rounded to half precision")
    p.add_argument("--width", type=int, default=32, help="bits of a fixed-point value")
    p.add_argument("--lanes", type=int, default=4)
    return Params(**vars(p.parse_args(list(argv))))
