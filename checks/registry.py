"""All checks by name: (query, SQL or None)."""

from __future__ import annotations

from checks import drifting, operations, profiling

CHECKS = {**profiling.CHECKS, **drifting.CHECKS, **operations.CHECKS}
