"""Named queries over the fixture tables, each with the SQL that DuckDB must agree with."""

from broadsheet.queries import archive_queries, article_queries, corpus_queries  # noqa: F401
from broadsheet.queries import label_queries, link_queries, markup_queries  # noqa: F401
from broadsheet.queries import model_queries  # noqa: F401
from broadsheet.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
