"""Helpers for long Column expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value) with `value` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a Java one: `*` crosses slashes and dots."""
    return re.sub(r"\\Z$|\\z$", "", fnmatch.translate(glob)).replace("(?s:", "^(?s:") + "$"
