"""All registered queries; importing the modules fills the registry."""

from newsloom.catalog.base import ORACLES, QUERIES

import newsloom.catalog.events  # noqa: F401, E402
import newsloom.catalog.texts  # noqa: F401, E402
import newsloom.catalog.feeds  # noqa: F401, E402
import newsloom.catalog.audience  # noqa: F401, E402
import newsloom.catalog.pages  # noqa: F401, E402
import newsloom.catalog.ingest  # noqa: F401, E402
import newsloom.catalog.streams  # noqa: F401, E402

__all__ = ["ORACLES", "QUERIES"]
