"""All registered queries."""

from checks import (eval_checks, model_checks, table_checks, term_checks, text_checks,  # noqa: F401
                    vector_checks)
from checks.core import QUERIES, SQL  # noqa: F401
