"""Every registered query of the engine itself, with the SQL that it must match."""

from __future__ import annotations

from .plans import content, pages, site, web

QUERIES: dict = web.QUERIES | content.QUERIES | pages.QUERIES | site.QUERIES
ORACLES: dict = web.ORACLES | content.ORACLES | pages.ORACLES | site.ORACLES
#: Those without SQL.
TESTED: dict = pages.TESTED
