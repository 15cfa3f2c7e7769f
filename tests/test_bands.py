"""Bands of column pieces from counts of neighbouring pieces, against a fold over the rows themselves."""

import random

import pandas as pd

from trustframe.functions import fixed_values as V
from trustframe.operators import regions as R


def fold_rows(rows, pieces):
    """rows: sets of used pieces. A piece joins the band when at least BAND_OVERLAP of the rows of either use both."""
    band, first, out = 1, 1, [1]
    for piece in range(2, pieces + 1):
        inside = [bool(r & set(range(first, piece))) for r in rows]
        both = sum(i and piece in r for i, r in zip(inside, rows))
        either = sum(i or piece in r for i, r in zip(inside, rows))
        if not both or both / either < V.BAND_OVERLAP:
            band, first = band + 1, piece
        out.append(band)
    return out


def test_bands_of_random_sheets():
    rng = random.Random(8)
    for _ in range(300):
        pieces = rng.randint(1, 9)
        core = {p for p in range(1, pieces + 1) if rng.random() < 0.7}
        rows = [{p for p in range(1, pieces + 1) if (p in core) != (rng.random() < 0.1)} for _ in range(rng.randint(1, 30))]
        rows += [{p} for p in range(1, pieces + 1)]                             # every piece is used somewhere
        pairs = [("s", "t", p, max([q for q in r if q < p], default=0), 1) for r in rows for p in r]
        frame = pd.DataFrame(pairs, columns=["source_id", "sheet", "piece", "before", "rows"])
        got = R.fold_pieces(frame.groupby(["source_id", "sheet", "piece", "before"], as_index=False).sum().sample(frac=1, random_state=1))
        assert got.sort_values("piece").band.tolist() == fold_rows(rows, pieces)
