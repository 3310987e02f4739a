"""One-bit quantization: a rotated residual keeps its signs and two factors.

With r the rotated residual of a vector to a reference and d its dimensions:
bits r > 0; f_add = |r|^2; f_rescale = |r|^2 sqrt(d) / |r|_1; f_error bounds the
estimate's error with high probability, not always. A code column is
STRUCT<dim INT, f_add FLOAT, f_rescale FLOAT, bits BINARY>, bits least first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .vectors import VectorError, _c

CODE = "struct<dim:int,f_add:float,f_rescale:float,bits:binary>"
DEFAULT_SEED = 42
# The error factor is 1.9 standard deviations; symmetric estimates err three times as much.
SIGMAS = 1.9
SYMMETRIC_FACTOR = 3.0
RELATIVE_SLACK = 1e-5
EXACT_SLACK = 2e-4


@dataclass(frozen=True)
class Rotation:
    """A seeded orthogonal matrix."""

    dim: int
    seed: int = DEFAULT_SEED

    @property
    def matrix(self) -> np.ndarray:
        return _orthogonal(self.dim, self.seed)

    def __repr__(self) -> str:
        return f"{{{self.dim}:{self.seed}}}"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix


@lru_cache(maxsize=8)
def _orthogonal(dim: int, seed: int) -> np.ndarray:
    """From the QR factors of a Gaussian matrix, signs fixed, so that it is uniform and the same everywhere."""
    if dim < 1:
        raise VectorError("a rotation has at least 1 dimension")
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def encode_residuals(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, f_add, f_rescale, f_error) of rotated residuals, a row each."""
    d = r.shape[1]
    bits = np.packbits(r > 0, axis=1, bitorder="little")
    f_add = (r * r).sum(1)
    half = np.abs(np.where(r > 0, r, -r).sum(1)) / 2
    f_rescale = f_add * np.sqrt(d) / (2 * np.maximum(half, 1e-10))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = 2 * SIGMAS / np.sqrt(max(d - 1, 1)) * np.sqrt(np.maximum(f_rescale**2 - f_add, 0))
        exact = (d <= 1) | (f_add == 0) | (f_rescale**2 <= f_add)
    return bits, f_add, f_rescale, np.where(exact, EXACT_SLACK * np.sqrt(f_add), spread)


def unpack(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, bitorder="little", count=dim)


def estimate(q: np.ndarray, bits: np.ndarray, f_add: np.ndarray, f_rescale: np.ndarray) -> np.ndarray:
    """Squared l2 estimates of one rotated query residual to coded rows (asymmetric: the query keeps its values)."""
    d = len(q)
    signed = 2 * (unpack(bits, d).astype(np.float64) @ q) - q.sum()
    return f_add + q @ q - 2 * f_rescale * signed / np.sqrt(d)


def estimate_symmetric(q: np.ndarray, bits: np.ndarray, f_add: np.ndarray, f_rescale: np.ndarray) -> np.ndarray:
    """The same from the query's signs alone."""
    d = len(q)
    far = hamming(np.packbits(q > 0, bitorder="little")[None], bits)
    return f_add + q @ q - 2 * f_rescale * np.abs(q).mean() * (d - 2 * far) / np.sqrt(d)


def lower_bound(est: np.ndarray, f_error: np.ndarray, q_norm: float, symmetric: bool = False) -> np.ndarray:
    return est - (SYMMETRIC_FACTOR if symmetric else 1.0) * f_error * q_norm - RELATIVE_SLACK * np.abs(est)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


# ---- columns ----


def encode(v: Column | str, reference: list[float], rotation: Rotation) -> Column:
    """Code of each vector against a reference; null stays null."""
    if len(reference) != rotation.dim:
        raise VectorError(f"different vector dimensions {len(reference)} and {rotation.dim}")
    ref = np.asarray(reference, np.float64)

    @pandas_udf(CODE)
    def run(v: pd.Series) -> pd.DataFrame:
        there = v.notna().to_numpy()
        rows = list(v[there])
        if any(len(x) != rotation.dim for x in rows):
            raise VectorError(f"different vector dimensions {len(next(x for x in rows if len(x) != rotation.dim))} and {rotation.dim}")
        x = np.array(rows, np.float64).reshape(-1, rotation.dim)
        bits, f_add, f_rescale, _ = encode_residuals(rotation(x - ref))
        out = pd.DataFrame({"dim": [rotation.dim] * len(v), "f_add": np.nan, "f_rescale": np.nan, "bits": None}, index=v.index).astype({"bits": object})
        out.loc[there, "f_add"], out.loc[there, "f_rescale"] = f_add.astype(np.float32), f_rescale.astype(np.float32)
        out.loc[there, "bits"] = pd.Series([b.tobytes() for b in bits], index=v.index[there], dtype=object)
        return out.astype({"dim": "int32", "f_add": "float32", "f_rescale": "float32"})

    v = _c(v)
    return F.when(v.isNotNull(), run(v))


def compare_codes(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by dimensions, then bytes of the bits; the factors don't count."""
    a, b = _c(a), _c(b)
    x, y = (F.struct(c["dim"], c["bits"]) for c in (a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(x < y, -1).when(x > y, 1).otherwise(0)


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Bits in which two codes differ, in the JVM."""
    a, b = _c(a)["bits"], _c(b)["bits"]

    def octet(bits: Column, i: Column) -> Column:
        return F.conv(F.hex(F.substring(bits, i, F.lit(1))), 16, 10).cast("int")

    each = F.transform(F.sequence(F.lit(1), F.octet_length(a)), lambda i: F.bit_count(octet(a, i).bitwiseXOR(octet(b, i))).cast("long"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x))


_CODE_TEXT = re.compile(r"^\s*\{([01]+):([^:{}]+):([^:{}]+)\}\s*$")


def parse_code(text: str) -> dict:
    """A code from '{0101:1.5:2.3}', first bit first."""
    m = _CODE_TEXT.match(text)
    if not m:
        raise VectorError(f'invalid input for a code: "{text}"')
    try:
        add, rescale = (float(np.float32(x)) for x in (m[2], m[3]))
    except ValueError:
        raise VectorError(f'invalid input for a code: "{text}"') from None
    if not np.isfinite([add, rescale]).all():
        raise VectorError("factors of a code must be finite")
    return {"dim": len(m[1]), "f_add": add, "f_rescale": rescale, "bits": np.packbits([int(c) for c in m[1]], bitorder="little").tobytes()}


def format_code(code: dict) -> str:
    bits = np.unpackbits(np.frombuffer(code["bits"], np.uint8), bitorder="little", count=code["dim"])
    return "{" + "".join(map(str, bits)) + f":{code['f_add']:.8g}:{code['f_rescale']:.8g}" + "}"
