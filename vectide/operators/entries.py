"""The entries of a batch of list columns, coded once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Entries:
    """A batch's distinct pairs of a cell and a gene, in order of the cell: numbers, codes, summed values, and each cell's total (0 counts as 1)."""

    def __init__(self, genes: pa.ListArray, values: pa.ListArray | None) -> None:
        genes = genes.fill_null([]) if genes.null_count else genes
        flat, sizes = genes.flatten(), np.asarray(pc.list_value_length(genes))
        count = np.ones(len(flat)) if values is None else np.asarray((values.fill_null([]) if values.null_count else values).flatten(), dtype=float)
        cell = np.repeat(np.arange(len(sizes)), sizes)
        if flat.null_count:
            kept = np.asarray(flat.is_valid())
            flat, count, cell = flat.drop_null(), count[kept], cell[kept]
        coded = flat.dictionary_encode()
        self.cells, self.genes = len(sizes), coded.dictionary
        code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        total = np.bincount(cell, weights=count, minlength=self.cells)
        total[total == 0] = 1
        pair, at = np.unique(cell * width + code, return_inverse=True)
        self.cell, self.code, self.value, self.total = pair // width, pair % width, np.bincount(at, weights=count, minlength=len(pair)), total

    def normalised(self, target: float) -> np.ndarray:
        return self.value * target / self.total[self.cell]

    def places(self, names: pa.Array) -> np.ndarray:
        """Where each entry's gene stands in ``names``; -1 if it does not."""
        known = pc.index_in(self.genes.cast(names.type), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
        return known[self.code] if len(self.code) else np.zeros(0, dtype=np.int64)
