"""Where names come from and go to."""

from onomast.sources.lines import matches_as_lines, names_of, read_lines, records_as_lines, stream_lines

__all__ = ["matches_as_lines", "names_of", "read_lines", "records_as_lines", "stream_lines"]
