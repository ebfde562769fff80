"""Sources that a job can do without."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException

#: What Spark says of files that are missing or can't be read.
_UNREADABLE = re.compile(r"FAILED_READ_FILE|CANNOT_READ_FILE|is not a Parquet file|FileNotFoundException|java\.io\.IOException|No such file")


def optional(what: str, read):
    """read(), which should write or collect what it reads; None where the source is missing, unreadable or of another shape, which is said. Other errors are raised."""
    try:
        return read()
    except AnalysisException as e:  # no such path or column
        print(f"no {what}: {str(e).splitlines()[0]}")
    except (PySparkException, Py4JJavaError, FileNotFoundError) as e:
        said = [x for x in str(e).splitlines() if _UNREADABLE.search(x)]
        if not said:
            raise
        print(f"no {what}: {said[0]}")
    return None
