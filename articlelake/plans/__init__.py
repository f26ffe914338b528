"""Registered queries. Importing this package fills the registry."""

from articlelake.plans.registry import REGISTRY  # noqa: F401
from articlelake.plans import extraction, images, intake, library, narration, search, streams  # noqa: F401
