"""Column functions over names, and their SQL registration."""

from onomast.functions.matching import names_consistent, names_variants_match
from onomast.functions.names import (
    NAME_SCHEMA,
    byte_len,
    display_first_last,
    display_full,
    display_full_with_honorifics,
    display_initial_surname,
    first_initial,
    generational_suffix,
    given_name,
    goes_by_middle_name,
    json_record,
    middle_initials,
    middle_name,
    middle_names,
    parse_name,
    surname,
    surname_hash,
)
from onomast.functions.registry import register

__all__ = [
    "NAME_SCHEMA", "byte_len", "display_first_last", "display_full", "display_full_with_honorifics", "display_initial_surname",
    "first_initial", "generational_suffix", "given_name", "goes_by_middle_name", "json_record", "middle_initials", "middle_name",
    "middle_names", "names_consistent", "names_variants_match", "parse_name", "register", "surname", "surname_hash",
]
