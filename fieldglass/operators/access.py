"""Row and column security that is part of what a query means: scope, masks, levels, reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caller:
    """Who asks: a department (None: all of them), permissions and a city or zone limit."""

    department: str | None = None
    permissions: tuple[str, ...] = ()
    city: str | None = None
    zone: str | None = None

    def may(self, permission: str) -> bool:
        return permission in self.permissions


def in_scope(caller: Caller, department: Column, city: Column | None = None, zone: Column | None = None) -> Column:
    """Whether a row of a department (and city, zone) is the caller's; a null never is, where there is a limit."""
    ok = F.lit(True) if caller.department is None else F.coalesce(department == caller.department, F.lit(False))
    for limit, column in ((caller.city, city), (caller.zone, zone)):
        if limit is not None and column is not None:
            ok = ok & F.coalesce(F.lower(F.trim(column)) == limit.strip().lower(), F.lit(False))
    return ok


def readable(facts: DataFrame, cameras: DataFrame, caller: Caller) -> DataFrame:
    """Facts of devices that exist and that the caller may read; scope comes before all assembly."""
    return facts.join(cameras.filter(in_scope(caller, F.col("department"))).select("camera_id"), "camera_id", "left_semi")


def masked(df: DataFrame, columns: list[str], allowed: Column, flag: str) -> DataFrame:
    """The columns set to null where they aren't allowed, and a flag that says so."""
    return df.withColumns({c: F.when(allowed, F.col(c)) for c in columns} | {flag: ~allowed})


def redacted(df: DataFrame, level: Column, visible: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Each of ``columns`` shown only at the visibility levels that list it."""
    return df.withColumns({c: F.when(level.isin(*[n for n, shown in visible.items() if c in shown]), F.col(c)) for c in columns})


def with_reason(reason: str, least: int = 8) -> str:
    """The stated reason; ValueError if it is too short to be one."""
    if len(reason.strip()) < least:
        raise ValueError(f"a reason of at least {least} characters is needed")
    return reason.strip()


def decided(gates: list[tuple[Column, str]], granted: str = "ALLOWED") -> Column:
    """The name of the first gate that doesn't hold, or ``granted``."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in gates), F.lit(granted))
