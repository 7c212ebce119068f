"""Registered queries by family."""

from . import causal, drift, learning, metrics, sessions, streams, tables

FAMILIES = (causal, sessions, metrics, drift, tables, learning, streams)
