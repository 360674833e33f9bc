"""The whole analysis over one transfer table; every stage is computed once, when first asked for.

Rows that break an invariant are counted as a stage is written and raise InvariantError; `verify` adds the checks that
need finished stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.cut import cut, stored
from tracewell.operators import episodes as E
from tracewell.operators import features as FE
from tracewell.operators import graph as G
from tracewell.operators import invariants as V
from tracewell.operators import links as L
from tracewell.operators import scoring as S
from tracewell.sources import results as R
from tracewell.sources import transfers as T

from .profile import DEFAULT, validate


class Case:
    """tx: transfers with flags (sources.transfers.flagged). Stages that later ones read several times are written once; so should tx be, which all of them read.

    Features and links may be given, say from an earlier run; given links must start at accounts that are flagged now.
    """

    def __init__(self, tx: DataFrame, profile: dict = DEFAULT, features: DataFrame | None = None, links: DataFrame | None = None) -> None:
        self.tx, self.profile = tx, validate(profile)
        if features is not None:
            self.features = features
        if links is not None:
            self.links = links
            V.raising("links", V.stale_links(links, self.pass1))

    def _checked(self, stage: str, df: DataFrame, never: dict) -> DataFrame:
        out, _ = V.checked(df, stage, never)
        return out

    @cached_property
    def inflows(self) -> DataFrame:
        return stored(E.inflow_episodes(self.tx))

    @cached_property
    def outflows(self) -> DataFrame:
        return self._checked("outflows", E.episode_outflows(self.tx, self.inflows), {"lag_outside_window": ~F.col("lag_s").between(0, E.WINDOW)})

    @cached_property
    def features(self) -> DataFrame:
        return stored(FE.features(self.tx, self.inflows, self.outflows))

    @cached_property
    def pass1(self) -> DataFrame:
        return stored(S.score(self.features, self.profile))

    @cached_property
    def candidates(self) -> DataFrame:
        return S.candidates(self.pass1, self.profile)

    @cached_property
    def links(self) -> DataFrame:
        links = L.layer_links(self.tx, self.candidates, self.inflows, E.episode_windows(self.inflows), self.outflows, self.profile)
        return self._checked("links", links, V.lag_outside(self.profile["windows_s"]))

    @cached_property
    def relations(self) -> DataFrame:
        return stored(S.relations(T.sides(self.tx), self.pass1, self.links))

    @cached_property
    def pass2(self) -> DataFrame:
        return stored(S.second_pass(self.features, self.relations, self.profile))

    @cached_property
    def roles(self) -> DataFrame:
        return self._checked("scores", S.roles(self.pass2, self.tx, self.profile), V.undecided())

    @cached_property
    def timed_links(self) -> DataFrame:
        return cut(self.links.join(self.tx.select("tx_key", "ts_sec"), "tx_key"))

    @cached_property
    def components(self) -> DataFrame:
        return G.components(self.links)

    @cached_property
    def on_cycle(self) -> DataFrame:
        return G.cycle_accounts(self.links)

    @cached_property
    def members(self) -> DataFrame:
        return cut(G.members(self.links, self.components, self.roles))

    @cached_property
    def rings(self) -> DataFrame:
        return cut(G.rings(self.timed_links, self.components, self.members, self.on_cycle, self.profile))

    @cached_property
    def _cells(self) -> tuple[DataFrame, DataFrame]:
        return G.cells(self.timed_links, self.components, self.members, self.rings, self.on_cycle, self.profile)

    @property
    def cells(self) -> DataFrame:
        return self._cells[0]

    @property
    def cell_members(self) -> DataFrame:
        return self._cells[1].join(self.cells.select("l1", "cell_id"), "l1")

    @cached_property
    def ring_of(self) -> DataFrame:
        """acct, ring_id of every linked account."""
        return cut(self.components.join(self.rings.select("label", "ring_id"), "label").select("acct", "ring_id"))

    @property
    def stamped_links(self) -> DataFrame:
        return self.links.join(self.ring_of.withColumnRenamed("acct", "from_acct"), "from_acct", "left").select(*self.links.columns, "ring_id")

    @property
    def stamped_scores(self) -> DataFrame:
        return self.roles.join(self.ring_of, "acct", "left").select(*self.roles.columns, "ring_id")

    @property
    def reasons(self) -> DataFrame:
        return S.reasons(self.roles, self.profile)

    def store(self, folder: str) -> dict[str, int]:
        """Refill this profile's rows of the tables scores, links, rings, cells and cell_members; their numbers."""
        tables = {"scores": self.stamped_scores, "links": self.stamped_links, "rings": self.rings, "cells": self.cells, "cell_members": self.cell_members}
        return {name: R.refill(df, folder, name, self.profile["profile_id"]) for name, df in tables.items()}

    def checks(self) -> DataFrame:
        """check, n: every invariant over the finished stages, each 0."""
        parts = [
            V.episode_checks(self.inflows, self.outflows), V.score_checks(self.features, self.roles), V.stale_links(self.links, self.pass1),
            V.network_checks(self.links, self.components, self.members, self.rings, self.cells, self.cell_members),
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def verify(self) -> None:
        V.raising("case", self.checks())

    def under(self, profile: dict) -> Case:
        """The same transfers under another profile; episodes and features, which no profile changes, are shared."""
        other = Case(self.tx, profile, self.features)
        other.inflows, other.outflows = self.inflows, self.outflows
        return other

    def preview(self, profile: dict) -> DataFrame:
        """Accounts whose score, flag, band or role another profile would change, before and after."""
        other = self.under(profile)
        side = lambda c, s: c.roles.select("acct", *(F.col(x).alias(f"{x}_{s}") for x in ("final_index", "is_flagged", "band", "role")))
        both = side(self, "before").join(side(other, "after"), "acct", "full")
        same = [F.col(f"{x}_before").eqNullSafe(F.col(f"{x}_after")) for x in ("is_flagged", "band", "role")]
        moved = F.abs(F.col("final_index_before") - F.col("final_index_after")) > 1e-9
        return both.filter(moved | ~(same[0] & same[1] & same[2]))
