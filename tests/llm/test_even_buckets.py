import random

import numpy as np
import pyarrow as pa


def test_pieces_are_dealt_evenly_into_buckets():
    from quillmere.llm.suffixes import PIECE, _ask, _marks

    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode() for _ in range(20)]
    out = _ask(0, 8)((pa.scalar(0),), pa.table({"m0": pa.array(_marks((400,))(texts)[0], pa.binary())}))
    sizes = np.array([len(h) // PIECE.itemsize for h in out["held"].to_pylist()])
    assert len(sizes) == 8 and sizes.max() < 1.5 * sizes.mean()
