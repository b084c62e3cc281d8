"""What a run will do: initial load or merge, of which type, over which columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import ConfigError, ScdConfig
from ..operators import scd


@dataclass(frozen=True)
class ScdPlan:
    """``operation`` is ``initial`` or ``incremental``; ``result`` is the new target, not yet computed."""

    config: ScdConfig
    operation: str
    business_columns: list[str]
    tracked_columns: list[str]
    result: DataFrame


def plan(batch: DataFrame, config: ScdConfig, target: DataFrame | None = None, full_refresh: bool = False, contract: T.StructType | None = None) -> ScdPlan:
    """Check ``config`` against ``batch`` and lay out the run. ``contract``: columns and types that the result
    must have, in any order."""
    config.check_columns(batch.schema)
    incremental = target is not None and not full_refresh
    result = scd.apply_incremental(target, batch, config) if incremental else scd.apply_initial(batch, config)
    if contract is not None:
        want = {f.name.upper(): f.dataType for f in contract.fields}
        have = {f.name.upper(): f.dataType for f in result.schema.fields}
        wrong = sorted(n for n in want.keys() | have.keys() if want.get(n) != have.get(n))
        if wrong:
            raise ConfigError("the result breaks its contract: " + "; ".join(f"{n} is {have[n].simpleString() if n in have else 'missing'}, declared {want[n].simpleString() if n in want else 'nowhere'}" for n in wrong))
    names = batch.columns
    return ScdPlan(config, "incremental" if incremental else "initial", config.business_columns(names), config.tracked_columns(names) if config.scd_type == 2 else [], result)
