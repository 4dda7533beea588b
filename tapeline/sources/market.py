"""Market data behind two interfaces: current data for daily work, and versions as they were known at a moment.

Both read tables of one ``FileProvider``; every method is a plan, so filters and columns reach the scan. A method whose
table the provider lacks raises ``Unsupported``; ``capabilities`` says so beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.expr import clean_code
from tapeline.operators import bars as B
from tapeline.operators import pit
from tapeline.sources.providers import FileProvider


class Unsupported(LookupError):
    """The provider has no table for what is asked."""


@dataclass(frozen=True)
class _Reader:
    spark: SparkSession
    provider: FileProvider

    def _rows(self, table: str, until: str | None = None) -> DataFrame:
        if table not in self.provider.capabilities:
            raise Unsupported(f"{self.provider.name} has no {table}")
        return self.provider.read(self.spark, table, until)


class MarketData(_Reader):
    """Current data: the latest version of everything."""

    def stock_list(self) -> DataFrame:
        """(code, name, market, exchange, list_date) of the codes listed now."""
        return pit.master_now(self._rows("security_master_versions")).where("list_status = 'L'").select("code", F.trim("name").alias("name"), "market", "exchange", "list_date")

    def daily_bars_by_date(self, day: date) -> DataFrame:
        """Usable bars of all codes on a date."""
        return B.usable_bars(self._rows("stock_daily_bar_versions").where(F.col("trade_date") == F.lit(day)))

    def daily_bars_for_stock(self, code: str, start: date, end: date) -> DataFrame:
        """Usable bars of one code, both dates included."""
        rows = self._rows("stock_daily_bar_versions")
        return B.usable_bars(rows.where((clean_code("code") == code.strip().upper()) & F.col("trade_date").between(F.lit(start), F.lit(end))))

    def trading_dates(self, start: date, end: date) -> DataFrame:
        """Distinct dates with bars, both ends included."""
        return self._rows("stock_daily_bar_versions").where(F.col("trade_date").between(F.lit(start), F.lit(end))).select(F.col("trade_date").alias("d")).distinct()

    def sector_data(self, day: date) -> DataFrame:
        """(sector_code, n, amount) of the industries' usable bars on a date."""
        members = pit.memberships(self._rows("stock_sector_membership"))
        placed = pit.pick_member(pit.member_on(members, self.daily_bars_by_date(day)))
        return placed.groupBy("sector_code").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("amount"))

    def index_daily(self, code: str, day: date) -> DataFrame:
        return self._rows("index_daily_bars").where((clean_code("code") == code.strip().upper()) & (F.col("trade_date") == F.lit(day)))


class PointInTimeData(_Reader):
    """Versions as they were known at ``until`` (a timestamp as text), never later ones."""

    #: What may be asked for, and the table it takes.
    TABLES = {
        "security_master_history": "security_master_versions", "daily_basic": "stock_daily_bar_versions", "daily_security_status": "security_master_versions", "historical_sector_membership": "stock_sector_membership",
        "historical_index_bars": "index_daily_bars", "corporate_actions": "corporate_actions", "adjustment_factors": "adjustment_factors",
    }

    def capabilities(self) -> dict[str, bool]:
        return {name: table in self.provider.capabilities for name, table in self.TABLES.items()}

    def security_master_versions(self, until: str) -> DataFrame:
        return self._rows("security_master_versions", until)

    def daily_basics(self, day: date, until: str) -> DataFrame:
        """(code, d, t, pe, pb) of the latest versions known."""
        rows = self._rows("stock_daily_bar_versions", until).where(F.col("trade_date") == F.lit(day))
        return B.latest_bars(rows).select("code", "d", "t", "pe", "pb")

    def security_statuses(self, until: str) -> DataFrame:
        """(code, list_status, special): the status known, and whether the name marks special treatment."""
        known = pit.master_now(self._rows("security_master_versions", until))
        return known.select("code", "list_status", F.coalesce(F.trim("name").rlike(r"^\*?ST"), F.lit(False)).alias("special"))

    def sector_memberships(self, day: date, until: str) -> DataFrame:
        """(code, sector_code) of all memberships known to be valid on a date."""
        held = pit.memberships(self._rows("stock_sector_membership", until))
        return held.where((F.col("valid_from") <= F.lit(day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(day)))).select("code", "sector_code").distinct()

    def index_daily_range(self, codes: Sequence[str], start: date, end: date) -> DataFrame:
        return self._between("index_daily_bars", start, end).where(clean_code("code").isin([c.strip().upper() for c in codes]))

    def corporate_actions(self, start: date, end: date) -> DataFrame:
        return self._between("corporate_actions", start, end)

    def adjustment_factors(self, start: date, end: date) -> DataFrame:
        return self._between("adjustment_factors", start, end)

    def _between(self, table: str, start: date, end: date) -> DataFrame:
        return self._rows(table).where(F.col("trade_date").between(F.lit(start), F.lit(end)))


def parquet_tables(root: str) -> FileProvider:
    """The Parquet tables of a folder of this project's test data."""
    return FileProvider("files", root, dict.fromkeys(("stock_daily_bar_versions", "security_master_versions", "stock_sector_membership"), "parquet"))


def feed_after(items: DataFrame, cursor_us: int, cursor_id: str, retain_us: int | None = None) -> DataFrame:
    """Items (evidence_id, first_seen_at, ...) strictly after a cursor in the order (first_seen_at, evidence_id), once each.

    With ``retain_us``, items that came that long before the newest one are past retention and left out. Redelivered items
    count at their first sight. Items without id or time never come.
    """
    at = F.unix_micros(F.col("first_seen_at").cast("timestamp"))
    seen = items.where("evidence_id is not null and first_seen_at is not null").groupBy("evidence_id").agg(F.min(at).alias("seen_us"))
    if retain_us is not None:
        newest = seen.agg(F.max("seen_us").alias("newest"))
        seen = seen.crossJoin(F.broadcast(newest)).where(F.col("seen_us") > F.col("newest") - retain_us).drop("newest")
    return seen.where((F.col("seen_us") > cursor_us) | ((F.col("seen_us") == cursor_us) & (F.col("evidence_id") > cursor_id)))
