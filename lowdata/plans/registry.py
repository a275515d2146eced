"""All registered queries: importing this module fills ``QUERIES`` with every group."""

# order matters: later groups may refine entries of earlier ones
from lowdata.plans import q_splits  # noqa: F401,I001
from lowdata.plans import q_sampling  # noqa: F401
from lowdata.plans import q_eval  # noqa: F401
from lowdata.plans import q_results  # noqa: F401
from lowdata.plans import q_augment  # noqa: F401
from lowdata.plans import q_model  # noqa: F401
from lowdata.plans import q_misc  # noqa: F401
from lowdata.plans.queries import QUERIES

QUERIES["raw_pair_roundtrip"] = (QUERIES["raw_pair_roundtrip"][0], QUERIES["pair"][1])  # the second append wins
QUERIES["table_roundtrip"] = (QUERIES["table_roundtrip"][0], QUERIES["pair"][1])

__all__ = ["QUERIES"]
