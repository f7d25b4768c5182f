"""Tieout: reconciliation and data assurance as Spark DataFrame operators.

Modules: ``operators`` (match, checks, gate, exceptions, audit, registry,
policy, controls), ``plans`` (positional primitives, composed flows, the
registered query catalogue), ``functions`` (column helpers), ``sources``
(tables, fixtures, writers), ``streaming`` (the gate on a stream).
"""

__version__ = "0.1.0"
