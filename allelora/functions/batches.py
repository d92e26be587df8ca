"""Arrow batches of genotype vectors as numpy matrices, for kernels that touch every element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

EOV = -2147483647


def _blocks(vectors: pa.ListArray, n_samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values = vectors.values.to_numpy(zero_copy_only=False)
    if len(values) and values.dtype != np.int32:  # null elements: missing
        values = np.nan_to_num(values, nan=-1).astype(np.int32)
    offsets = vectors.offsets.to_numpy()
    lengths, valid = np.diff(offsets), np.asarray(vectors.is_valid())
    for length in np.unique(lengths[valid]).tolist():
        ploidy = length // n_samples
        if ploidy:
            rows = np.flatnonzero(valid & (lengths == length))
            at = offsets[rows][:, None] + np.arange(ploidy * n_samples)[None, :]
            yield rows, values[at].reshape(len(rows), n_samples, ploidy)


def allele_blocks(vectors: pa.ListArray, n_samples: int) -> Iterator[np.ndarray]:
    """Rows x samples x ploidy for the rows of one vector length each; elements beyond are left out, null and short vectors too."""
    return (block for _, block in _blocks(vectors, n_samples))


def dosage_blocks(vectors: pa.ListArray, n_samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, dosages) for the rows of one vector length each: a matrix rows x samples, NaN for a sample with a missing allele.

    The ploidy is length div n_samples; elements beyond ploidy x n_samples are left out, end-of-vector elements
    count as nothing. Null vectors and those with fewer elements than samples are in no block.
    """
    for rows, block in _blocks(vectors, n_samples):
        end = block == EOV
        missing = ((block < 0) & ~end).any(axis=2)
        yield rows, np.where(missing, np.nan, np.where(end, 0, block).sum(axis=2).astype(float))
