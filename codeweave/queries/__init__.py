"""Registered queries, one module per operator family."""

from . import (calls, classes, functions, imports, location, modules, patterns,  # noqa: F401
               similarity, sqlapi, types)
