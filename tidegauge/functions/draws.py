"""Random draws that depend on the row's key only.

`rand(seed)` depends on how rows are partitioned, so a re-run on another cluster, or a task
retried after a lost executor, would inject different noise. Hashing (seed, channel, key)
gives every row its own reproducible draw.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | Column, salt: str, *key: Column) -> Column:
    """Uniform draw in [0, 1) from 52 bits of an md5 over seed, salt and key.

    The seed may be a column, so that many seeded runs live in one table.
    """
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", first, F.lit(salt), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def normal(seed: int | Column, salt: str, *key: Column) -> Column:
    """Standard normal draw by the Box-Muller transform of two uniforms."""
    u1 = F.greatest(uniform(seed, f"{salt}/a", *key), F.lit(1e-300))
    u2 = uniform(seed, f"{salt}/b", *key)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
