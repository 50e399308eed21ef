"""The tables one validation or readiness run reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Product:
    """A product at one point in time; ``root`` has one row (root_rev), ``live`` the revisions below it.

    Contracts carry ``envelope_dx``, ``envelope_dy``, ``envelope_dz`` and ``cg_window``, null where not declared.
    ``socket`` may name what a pattern is read off (from_instance, from_interface); ``dimension`` has the declared dimensions of revisions."""

    part: DataFrame
    rev: DataFrame
    occ: DataFrame
    shape: DataFrame
    contract: DataFrame
    interface: DataFrame
    socket: DataFrame
    chain: DataFrame
    member: DataFrame
    subscription: DataFrame
    root: DataFrame
    live: DataFrame
    dimension: DataFrame | None = None
