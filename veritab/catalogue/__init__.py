"""Named queries over the test tables, each with the SQL that must give the same rows."""

from veritab.catalogue import cleaning, metadata, models, profiles  # noqa: F401
from veritab.catalogue.base import QUERIES, SQL  # noqa: F401
