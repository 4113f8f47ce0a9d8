"""Nicknames of English given names, and other spellings.

``IRREGULAR`` maps a nickname to names it stands for; ``STEMS`` does so for nicknames
in -y, -ie or -ey without that ending.
"""

from __future__ import annotations


def _table(text: str) -> dict[str, tuple[str, ...]]:
    rows = (line.split(":") for line in text.strip().split("\n"))
    return {nick.strip(): tuple(names.split()) for nick, names in rows}


IRREGULAR = _table("""
Ada: Adelaide Adele Adelina Adeline
Ag: Agnes Agatha
Al: Albert Alan Alexander Alfred Alonzo Alvin
Alec: Alexander
Alex: Alexander Alexandra Alexis
Ann: Agnes Anna Anne Hannah Nancy
Annie: Agnes Ann Anna Anne Luann
Beth: Elizabeth
Betsy: Elizabeth
Bess: Elizabeth
Bill: William
Bob: Robert
Bram: Abraham
Chuck: Charles
Dick: Richard
Dolly: Dorothy Dolores
Dot: Dorothy
Dottie: Dorothy
Ed: Edgar Edmund Eduardo Edward Edwin
Eliza: Elizabeth
Fran: Frances Francis
Frank: Francis Franklin
Fritz: Frederick Friedrich
Gene: Eugene
Gus: August Augustus Gustav
Hal: Harold Henry
Hank: Henry
Harry: Harold Henry
Jack: John
Jim: James
Kate: Catherine Katherine Kathleen
Kit: Christopher Katherine
Larry: Laurence Lawrence
Len: Leonard
Lon: Alonzo
Lousie: Louise
Lulu: Louise Lucille Lucinda
Maggie: Margaret
Marianne: Mary Mariana
Meg: Margaret
Mike: Michael
Molly: Mary
Nan: Agnes Ann Nancy
Nancy: Ann Anne
Ned: Edgar Edmund Edward Edwin
Nell: Eleanor Ellen Helen
Peg: Margaret
Peggy: Margaret
Polly: Mary Paula
Rick: Eric Frederick Richard
Rob: Robert
Sally: Sarah
Sandy: Alexander Alexandra Sandra
Sasha: Alexander Alexandra
Ted: Edmund Edward Theodore
Tony: Anthony Antonio
Topher: Christopher
Trish: Beatrice Patricia
Trisha: Beatrice Patricia
Trix: Beatrice Beatrix Patricia
Will: William
Xander: Alexander
""")

STEMS = _table("""
Ab: Abigail Abraham
Ad: Adam Adelaide
Andr: Andrew Andrea
Benn: Benjamin Bennett Benedict
Bern: Bernard
Bert: Albert Herbert Robert Gilbert
Bess: Elizabeth
Bett: Elizabeth Bettina
Bill: William
Bobb: Robert Roberta
Bob: Robert
Cath: Catherine
Charl: Charles Charlotte
Chris: Christopher Christina Christine
Ciss: Cecilia
Dann: Daniel Danielle
Debb: Deborah
Dor: Dorothy Doris
Dott: Dorothy
Edd: Edgar Edmund Eduardo Edward Edwin
Ell: Eleanor Ellen Elizabeth
Frank: Francis Franklin
Fredd: Alfred Frederick Winifred
Gabb: Gabriel Gabrielle
Gerr: Gerald Geraldine
Gertr: Gertrude
Gust: August Augustus Gustav
Jack: John Jacqueline
Jenn: Jennifer
Jerr: Gerald Jeremy Jerome
Jimm: James
Johnn: John Jonathan
Josi: Josephine
Kath: Katherine Kathleen
Kit: Katherine
Lenn: Leonard
Lizz: Elizabeth
Louis: Louise
Lou: Louis Louise
Magg: Margaret
Marg: Margaret
Matt: Matthew Matilda
Maud: Matilda
Mick: Michael
Mill: Mildred Millicent
Minn: Minerva Wilhelmina
Nell: Eleanor Ellen Helen
Nick: Nicholas
Pats: Patricia
Patt: Patricia Patrick
Pegg: Margaret
Pegg: Margaret
Rich: Richard
Rick: Eric Frederick Richard
Robb: Robert
Ronn: Ronald Veronica
Rud: Rudolph
Samm: Samuel Samantha
Sand: Alexander Sandra
Stev: Stephen Steven
Suz: Susan Suzanne
Tedd: Edward Theodore
Terr: Terence Theresa
Thedd: Theodore
Till: Matilda
Timm: Timothy
Tomm: Thomas
Ton: Anthony Antonio
Trix: Beatrice
Vinn: Vincent
Wall: Walter Wallace
Will: William
Winn: Winifred
""")


def variants(name: str) -> list[str]:
    """A name and the names it may stand for."""
    out = [name, *IRREGULAR.get(name, ())]
    if len(name) >= 4 and name[-2:] in ("ie", "ey"):
        out += STEMS.get(name[:-2], ())
    elif len(name) >= 3 and name[-1] == "y":
        out += STEMS.get(name[:-1], ())
    return out
