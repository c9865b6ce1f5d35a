"""Input tables: Parquet readers, column checks and the fixture mapping views."""

from segmenta.sources.tables import (
    FIXTURE_VIEWS,
    bonuscheques,
    load_fixtures,
    read_table,
    require_columns,
    shops,
    stat,
    stat_irregular,
    userentry,
    userentry_months,
    users,
)

__all__ = [
    "FIXTURE_VIEWS",
    "bonuscheques",
    "load_fixtures",
    "read_table",
    "require_columns",
    "shops",
    "stat",
    "stat_irregular",
    "userentry",
    "userentry_months",
    "users",
]
