"""All queries over the standard tables and the SQL that states their results."""

from __future__ import annotations

from . import book_plans, misc_plans, text_plans

QUERIES: dict = {**text_plans.QUERIES, **book_plans.QUERIES, **misc_plans.QUERIES}
SQL: dict = {**text_plans.SQL, **book_plans.SQL, **misc_plans.SQL}
