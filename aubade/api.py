"""Fluent queries over an archive, with the option checks of the command line it replaces."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aubade.operators import ranking as R
from aubade.operators import segments as S
from aubade.operators import warehouse as W

TRACK_AXES = ("work", "piece", "composer", "conductor", "year", "form")
SEGMENT_AXES = ("recording", "contributor", "broadcaster", "country", "segment_work")
SEGMENT_ONLY = ("length",)
TRACK_ONLY = ("title", "composer", "conductor", "christmas")


class OptionError(ValueError):
    """A combination of options that has no meaning."""


@dataclass(frozen=True)
class Archive:
    """The three base tables and the filters chosen so far. Every method gives a new archive; nothing runs before the result is used."""

    episodes: DataFrame
    tracks: DataFrame
    segment_events: DataFrame
    options: dict[str, Any] = field(default_factory=dict)

    def _with(self, **options: Any) -> Archive:
        return replace(self, options=self.options | options)

    def between(self, after: str | None = None, before: str | None = None) -> Archive:
        """Nights from ``after`` to ``before``, both included."""
        return self._with(after=after, before=before)

    def year(self, year: int) -> Archive:
        """Nights of one year."""
        return self._with(year=year)

    def christmas(self) -> Archive:
        """Nights of 24 to 26 December."""
        return self._with(christmas=True)

    def title(self, phrase: str) -> Archive:
        """Titles with a phrase."""
        return self._with(title=phrase)

    def composer(self, phrase: str) -> Archive:
        """All rows of composers of whom any spelling matches."""
        return self._with(composer=phrase)

    def conductor(self, phrase: str) -> Archive:
        """All tracks under conductors of whom any spelling matches."""
        return self._with(conductor=phrase)

    def length(self, least: int | None = None, most: int | None = None) -> Archive:
        """Segments within a band of seconds."""
        return self._with(length=(least, most))

    def airings(self, least: int | None = None, most: int | None = None) -> Archive:
        """Results within a band of airings."""
        return self._with(band=(least, most))

    def _check(self, axis: str) -> None:
        if axis not in TRACK_AXES + SEGMENT_AXES:
            raise OptionError(f"no axis {axis!r}")
        wrong = [o for o in (SEGMENT_ONLY if axis in TRACK_AXES else TRACK_ONLY) if self.options.get(o)]
        if wrong:
            raise OptionError(f"{', '.join(wrong)} doesn't apply to {axis}")
        if axis == "year" and "band" in self.options:
            raise OptionError("a band of airings doesn't apply to year")
        if self.options.get("year") and (self.options.get("after") or self.options.get("before")):
            raise OptionError("a year and a range of dates exclude each other")

    def rows(self) -> DataFrame:
        """The airings that pass the filters."""
        o = self.options
        air = R.in_dates(R.airings(self.tracks, self.episodes), o.get("after"), o.get("before"), o.get("year"), o.get("christmas", False))
        if o.get("title"):
            air = R.title_matches(air, o["title"])
        if o.get("composer"):
            air = R.composer_identity(air, o["composer"])
        return R.conductor_identity(air, o["conductor"]) if o.get("conductor") else air

    def segments(self) -> DataFrame:
        """The segments that pass the filters."""
        o = self.options
        nights = self.episodes.select("pid", R.broadcast_day(F.col("broadcast_date")).alias("bdate"))
        rows = self.segment_events.join(nights, F.col("episode_pid") == F.col("pid")).drop("pid").withColumn("yr", F.year("bdate"))
        from aubade.functions.titlekey import composer_key

        rows = R.in_dates(rows, o.get("after"), o.get("before"), o.get("year")).withColumn("ck", composer_key(F.col("composer_name")))
        return S.duration_band(rows, *o["length"]) if o.get("length") else rows

    def by(self, axis: str, top: int | None = None) -> DataFrame:
        """A ranking by an axis, best first; all of it, or ``top`` rows."""
        self._check(axis)
        if axis in TRACK_AXES:
            made = {"work": R.rank_works, "piece": R.rank_pieces, "composer": R.rank_composers, "conductor": R.rank_conductors, "year": R.years, "form": R.forms}[axis](self.rows())
        else:
            segs = self.segments()
            made = {"recording": S.recordings, "broadcaster": S.broadcasters, "country": S.countries, "segment_work": S.works}[axis](segs) if axis != "contributor" else S.rank_contributors(S.role_rows(segs), segs)
        if self.options.get("band"):
            made = R.with_band(made, *self.options["band"])
        order = [F.col("yr")] if axis == "year" else [F.col("airings").desc(), *(F.col(c) for c in made.columns if c != "airings")]
        return made.orderBy(*order) if top is None else made.orderBy(*order).limit(top)

    def summary(self) -> DataFrame:
        """Totals of the filtered airings."""
        return R.summary(self.rows())

    def profile(self, phrase: str) -> dict[str, DataFrame]:
        """Small tables on the works whose title holds a phrase: years, composers, credits (K1)."""
        rows = R.title_matches(self.rows(), phrase)
        return {"works": R.rank_works(rows), "years": R.years(rows), "composers": R.rank_composers(rows), "credits": R.credits(rows).groupBy("role", "name").agg(F.count("*").alias("n"))}

    def csv(self, axis: str, path: str) -> None:
        """The whole ranking as CSV."""
        W.write_csv(self.by(axis), path)
