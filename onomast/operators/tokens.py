"""How a text is cut into tokens and what each is taken for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_TYPE = pa.list_(pa.struct([("word", pa.string()), ("kind", pa.string()), ("cased", pa.string()), ("chars", pa.int32()), ("letters", pa.int32())]))


def name_tokens(text: str | Column) -> Column:
    """array of (word, kind, cased, chars, letters); explode it for one row a token."""

    def kernel(texts: pa.Array) -> pa.Array:
        from onomast.kernel.parse import START, tokenise
        from onomast.kernel.text import mixed_case, normalised

        out = []
        for t in texts.to_pylist():
            plain = normalised(t) if t is not None else ""
            found = tokenise(plain, mixed_case(plain), START)
            out.append(None if t is None else [{"word": x.word, "kind": x.kind, "cased": x.cased, "chars": x.chars, "letters": x.letters} for x in found])
        return pa.array(out, _TYPE)

    schema = "array<struct<word:string,kind:string,cased:string,chars:int,letters:int>>"
    return F.arrow_udf(kernel, schema)(F.col(text) if isinstance(text, str) else text)


@udtf(returnType="at int, word string, kind string, cased string, chars int, letters int")
class TokenRows:
    """Table function: a row for each token of a text (``LATERAL tokenize_name(text)``)."""

    def eval(self, text: str):
        from onomast.kernel.parse import START, tokenise
        from onomast.kernel.text import mixed_case, normalised

        if text is not None:
            plain = normalised(text)
            for at, x in enumerate(tokenise(plain, mixed_case(plain), START)):
                yield at, x.word, x.kind, x.cased, x.chars, x.letters
