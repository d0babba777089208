from pairlab.sources.io import (  # noqa: F401
    PAIR_SCHEMA,
    nan_to_null,
    read_delimited,
    read_split,
    read_table,
    union_all,
    write_delimited,
)
