"""Every query of the panel engine by name, with its SQL twin."""

from __future__ import annotations

from monthgrid.plans import arms, detectors, evaluation, fine, joining, panels, roundtrips, scalars, signals
from monthgrid.plans.panels import flagship

MODULES = (panels, joining, evaluation, scalars, signals, detectors, arms, fine, roundtrips)
QUERIES = {name: f for m in MODULES for name, (f, _) in m.BOOK.items()}
ORACLES = {name: sql for m in MODULES for name, (_, sql) in m.BOOK.items() if sql}

__all__ = ["ORACLES", "QUERIES", "flagship"]
