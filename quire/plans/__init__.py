"""The registered queries, grouped by what they exercise."""

from quire.plans import corpus, evaluation, ingest, properties, textual, vectors  # noqa: F401
from quire.plans.registry import REGISTRY  # noqa: F401
