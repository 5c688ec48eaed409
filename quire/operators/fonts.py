"""Which font stands for a requested one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower


def decide(fonts: DataFrame, substitutions: dict[str, str], paths: list[str], embedded: list[str]) -> DataFrame:
    """requested, resolved, reason, with the columns of fonts.

    Embedded fonts come first, then fonts with a path in the profile, then substitutions; names agree whatever the case
    of A-Z, and an exact name goes before one in another case. The profile is a small dictionary of the caller.
    """
    bare = lambda name: name.translate({i: i + 32 for i in range(65, 91)})
    lower: dict[str, str] = {}
    for name, other in substitutions.items():
        lower.setdefault(bare(name), other)
    requested = F.col("requested")
    look_up = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key) if table else F.lit(None).cast("string")
    among = lambda names: ascii_lower(requested).isin(*[bare(n) for n in names]) if names else F.lit(False)
    found = F.coalesce(look_up(substitutions, requested), look_up(lower, ascii_lower(requested)))
    kept = among(embedded) | among(paths)
    reason = F.when(among(embedded), "document embedded font").when(among(paths), "profile font path").when(found.isNotNull(), "profile substitution").otherwise("document font retained")
    return fonts.withColumns({"resolved": F.when(kept, requested).otherwise(F.coalesce(found, requested)), "reason": reason})
