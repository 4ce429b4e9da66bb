"""Registered queries over the given tables, each with an equivalent SQL check."""

from bindings import chain, matching, parsing, tables, web

MODULES = (matching, parsing, web, tables, chain)
