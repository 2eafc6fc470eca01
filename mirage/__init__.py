"""mirage — a Spark-native pipeline for building and scoring question sets
that test whether language models invent meanings for made-up terms.

Everything is expressed as DataFrame operators; see ``README.md`` for the map
from pipeline stages to modules.
"""

__version__ = "0.1.0"
