r"""Sentence boundaries across languages and scripts, in SQL expressions only.

Every step replaces characters one for one, so offsets stay those of the text: stops that end nothing (in numbers,
addresses, initials, abbreviations and quotations) become private-use placeholders, a mark is put behind every stop
that is left, the text is cut at the marks, and each placeholder stands for one character only, so the sentences are
restored by turning them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Placeholders: private-use characters, each for one character of the text.
CUT = chr(0xE000)  # a boundary; not in the text
PARA = chr(0xE001)  # a line feed that a blank line follows
PAIRS = (('"', '"'), ("\u201e", "\u201c"), ("\u201e", "\u201d"), ("\u201c", "\u201d"), ("\u00ab", "\u00bb"), ("\u300c", "\u300d"), ("\u300e", "\u300f"))
OPENED = "".join(chr(0xE010 + i) for i in range(len(PAIRS)))  # a quotation mark that is closed in the paragraph
CLOSED = "".join(chr(0xE020 + i) for i in range(len(PAIRS)))
DOT, ELLIPSIS = chr(0xE030), chr(0xE031)  # one of several full stops in a row, an ellipsis character
#: Stops of scripts in which one ends a sentence whatever follows.
SCRIPT_STOPS = "\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u203c\u2047\u2048\u2049\u1362"
LATIN_STOPS = ".!?" + DOT + ELLIPSIS
STOPS = LATIN_STOPS + SCRIPT_STOPS
HELD = "".join(chr(0xE040 + i) for i in range(len(STOPS)))  # a stop that ends nothing
STOP = HELD[0]  # ... for the full stop
RESERVED = CUT + PARA + OPENED + CLOSED + DOT + ELLIPSIS + HELD
MADE = PARA + OPENED + CLOSED + DOT + ELLIPSIS + HELD
MEANT = "\n" + "".join(a for a, _ in PAIRS) + "".join(b for _, b in PAIRS) + ".\u2026" + STOPS.replace(DOT, ".").replace(ELLIPSIS, "\u2026")

CLOSERS = CLOSED + "\"\u201d\u2019'\u00bb\u300d\u300f)\uff09\\]\u3011\u300b>}"
OPENERS = OPENED + "\"\u201c\u201e\u00ab\u300c\u300e(\uff08\\[\u00bf\u00a1"
EMOJI = "\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}\\x{200D}"
#: What belongs to a stop: further stops, closing marks, emoji.
TAIL = f"[{STOPS}]*+(?:(?:[^\\S\\n]?[{CLOSED}]|[{CLOSERS}])[{STOPS}]*+)*+(?:[^\\S\\n]*+[{EMOJI}]++)*+"

# Abbreviations without their full stop. Fixed values.
#: Never the end of a sentence.
ALWAYS = "approx vs viz cf ca bzw evtl ggf inkl exkl zzgl bspw vgl ej aprox págs env ок стр ул тыс напр रु م د أ"
#: No end before a name.
TITLES = "mr mrs ms dr prof rev hon gen sen rep gov capt col lt sgt messrs mme mlle sr sra srta dra st ste don श्री डॉ सुश्री प्रो"
#: No end before a number.
NUMBERED = "no nos nr nrn núm nº sec secs art arts abs fig figs vol ch chap pp p pg pág pag s v ver п пп гл рис पृ ص rs jan feb mar apr jun jul aug sep sept oct nov dec"
#: No end before a small or caseless letter.
SOMETIMES = "etc usw inc ltd corp co cos llc LLC plc bros jr al UU FF руб коп др пр г гг вв mio mrd tsd dept est ave blvd"
#: Letters in a chain ("e.g.", "z. B.") that never end one.
CHAINS = "e.g i.e n.b z.b d.h i.d o.ä т.е т.ч т.к"
#: German words before which a number with a full stop is an ordinal, and before which "Mio." is no end.
ORDINAL_NOUNS = "Januar Jan Februar Feb März April Mai Juni Juli August September Oktober November Dezember Quartal Halbjahr Jahrhundert Jahrestag Geburtstag Mal Platz Rang Stock Auflage Klasse Kapitel Tag Woche Monat Jahr"
UNITS = "Euro EUR US Dollar USD Franken CHF Yen Pfund Kronen Stück Tonnen Aktien Barrel"

LEFT = "(?<![\\p{L}\\p{N}\\p{M}])"  # not within a longer word


def _any(words: str) -> str:
    both = {v for w in words.split() for v in (w, w[0].upper() + w[1:])}
    return "|".join(sorted(both, key=lambda w: (-len(w), w)))


def _swap(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _bound(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step(c)`` with ``c`` computed once, however often the step names it."""
    return F.element_at(F.transform(F.array(c), step), 1)


def _swap_if(c: Column, has: str, pattern: str, to: str) -> Column:
    """``_swap`` for texts that contain ``has``; looking for it costs far less than the pattern."""
    return _bound(c, lambda v: F.when(v.contains(has), _swap(v, pattern, to)).otherwise(v))


def _held_stops() -> str:
    """One pattern for every full stop that ends nothing. It begins with the stop, so that only stops are looked at."""
    follows = f"[{CLOSERS}]*+(?:\\s*+[\\p{{Ll}}\\p{{Lo}}]|[,;:])"
    name = "\\p{Lu}[\\p{L}\\p{M}'\\u2019-]"
    chains = "|".join(w.replace(".", "[.]\\s?") for w in CHAINS.split())
    rules = [
        # within numbers, tickers and addresses
        ("[\\p{L}\\p{N}/_=%&#~-]", "[\\p{Ll}\\p{N}_-]"),
        ("\\p{Lu}", "[\\p{Lu}\\p{N}]"),
        ("\\s", "\\p{N}"),
        # letters with stops: all but the last of a chain, initials, the last of a chain
        (f"{LEFT}\\p{{L}}\\p{{M}}{{0,3}}", "[ \\u00a0\\u202f\\n]?\\p{L}[.]"),
        (f"(?:^|[\\s(\\[{OPENERS}-])(?!I)\\p{{Lu}}", f"\\s+{name}"),
        ("\\p{Lu}[.]\\sI", f"\\s+{name}"),
        (f"{LEFT}(?i:{chains})", ""),
        (f"{LEFT}\\p{{L}}[.]\\s?\\p{{L}}", follows),
        *[(f"{LEFT}{x}", f"\\s?{y}(?![\\p{{L}}\\p{{M}}])") for x, y in (("u", "a"), ("z", "B"), ("d", "h"), ("т", "[дпек]"))],
        # abbreviations
        (f"{LEFT}p", "\\s(?:ej|ex)[.]"),
        ("p[.]\\s(?:ej|ex)", ""),
        (f"{LEFT}EE", "\\s?UU"),
        (f"{LEFT}(?:{_any(ALWAYS)})", f"\\s*+[^\\s{PARA}]"),
        (f"{LEFT}(?:{_any(TITLES)})", "\\s*+[\\p{Lu}\\p{Lo}]"),
        (f"{LEFT}(?:{_any(NUMBERED)})", "\\s*+\\p{Nd}"),
        (f"(?<!\\p{{Nd}}\\s)(?<!\\p{{Nd}}){LEFT}г", "\\s+\\p{Lu}"),
        (f"{LEFT}(?:Mio|Mrd|Tsd)", f"\\s+(?:{_any(UNITS)})\\b"),
        (f"{LEFT}(?:{_any(SOMETIMES)})", follows),
        (f"(?<![\\p{{L}}$,.\\p{{Nd}}])\\p{{Nd}}{{1,2}}", f"\\s+(?:{_any(ORDINAL_NOUNS)})\\b"),
    ]
    return "(?U)[.](?:" + "|".join(f"(?<={before}[.])(?={after})" for before, after in rules) + ")"


def masked(text: Column) -> Column:
    """The text with placeholders; as many characters as before."""
    c = F.translate(text, "…" + RESERVED, ELLIPSIS + "�" * len(RESERVED))
    c = _swap(c, "(?U)\\n(?=[^\\S\\n]*+\\n)", PARA)
    c = _swap(c, "[.](?:(?=[.])|(?<=[.][.]))", DOT)
    c = _swap(c, _held_stops(), STOP)
    c = _swap_if(c, "?", "[?](?<=[\\p{Ll}\\p{N}/][?])(?=[\\p{Ll}\\p{N}_]++=)", HELD[STOPS.index("?")])
    for x in (DOT, ELLIPSIS):
        c = _swap_if(c, x, f"(?U){x}(?=[{DOT}{ELLIPSIS}]*+[{CLOSERS}]*+(?:\\s*+\\p{{Ll}}|\\p{{Lo}}))", HELD[STOPS.index(x)])
    for (a, b), x, y in zip(PAIRS, OPENED, CLOSED):
        c = _swap_if(c, a, f"{a}([^{a}{b}{PARA}{OPENED}{CLOSED}]*+){b}", f"{x}$1{y}")
    return _bound(c, lambda v: F.when(v.rlike(f"[{OPENED}]"), _quotations(v)).otherwise(v))


def _quotations(c: Column) -> Column:
    """Hold the stops inside quotations, and the last ones if the words that name the speaker follow.

    A quotation that a comma or colon leads in ends with its own stop. Any goes on before a comma, one that nothing
    leads in also before a small or caseless letter.
    """

    def joined(pieces: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            tail = F.regexp_extract(s, f"(?U)[{STOPS}]*+\\s*+[{CLOSED}]$", 0)
            head = F.translate(F.substring(s, F.lit(1), F.length(s) - F.length(tail)), STOPS, HELD)
            before, after = F.coalesce(F.get(pieces, i - 1), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit(""))
            led_in = before.rlike("(?U)[,:\uff0c\u060c\uff1a\u3001]\\s*+$")
            goes_on = after.rlike("(?U)^\\s*+[,\uff0c\u060c\u3001;]|^(?:\u3068|\u3063\u3066)") | (~led_in & after.rlike("(?U)^\\s*+[\\p{Ll}\\p{Lo}]"))
            quoted = F.concat(head, F.when(goes_on, F.translate(tail, STOPS, HELD)).otherwise(tail))
            return F.when(s.rlike(f"^[{OPENED}][^{OPENED}{CLOSED}]*+[{CLOSED}]$"), quoted).otherwise(s)

        return F.array_join(F.transform(pieces, part), "")

    return _bound(F.split(c, f"(?=[{OPENED}])|(?<=[{CLOSED}])"), joined)


def marked(c: Column) -> Column:
    """Masked text with a mark behind every boundary."""
    no_touch = f"\\p{{Nd}}\\p{{IsLatin}}.{DOT}{STOP}\\s"
    thai = "ก-๏๚-๛"
    space = f"(?U)([{thai}][^\\S\\n]++)(?=[^{no_touch}])|([^{no_touch}][^\\S\\n]++)(?=[{thai}])"
    c = _bound(c, lambda v: F.when(v.rlike(f"[{thai}]"), _swap(v, space, f"$1$2{CUT}")).otherwise(v))
    ends = (
        f"[{LATIN_STOPS}]*+[{SCRIPT_STOPS}]{TAIL}",
        f"[{LATIN_STOPS}]{TAIL}(?=[\\s{PARA}{OPENERS}])",
        # a missing blank
        f"(?<=[\\p{{Ll}}\\p{{Nd}}%){CLOSED}])[{LATIN_STOPS}]{TAIL}(?=\\p{{Lu}}(?:[\\p{{Ll}}'\\u2019]|\\s))",
        PARA,
    )
    return _swap(c, f"(?U)(?=[{STOPS}{PARA}])(?:{'|'.join(ends)})", f"$0{CUT}")


def sentences(df: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per sentence: ident, ``sent_no`` (from 0), ``sent_start``, ``sent_end`` (exclusive, code points), ``sentence``.

    From the sentence's first to after its last non-blank character. NULL, empty and white-space texts have no sentence;
    a NULL ident is an ident; repeated rows are cut each for itself; extra columns are dropped. Private-use characters
    that are placeholders here come out as U+FFFD.

    Pieces are numbered and summed up per row of the input; when ``sentence`` isn't asked for, no text is shuffled.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("_tm_row"), F.col(ident).alias("_tm_id"), F.col(text).alias("_tm_t"))
    cut = rows.select("_tm_row", "_tm_id", F.posexplode(F.split(marked(masked(F.col("_tm_t"))), CUT)).alias("_tm_i", "_tm_s"))
    blank = f"[\\s{PARA}]"
    lead = F.length(F.regexp_extract("_tm_s", f"(?U)^{blank}*+", 0))
    core = F.regexp_extract("_tm_s", f"(?sU)^{blank}*+(.*[^\\s{PARA}])?", 1)
    sized = cut.select("_tm_row", "_tm_id", "_tm_i", F.length("_tm_s").alias("_tm_n"), lead.alias("_tm_lead"), F.length(core).alias("_tm_core"), F.translate(core, MADE, MEANT).alias("sentence"))
    order = W.partitionBy("_tm_row").orderBy("_tm_i")
    placed = sized.withColumn("_tm_at", F.sum("_tm_n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("_tm_n") + F.col("_tm_lead")).where(F.col("_tm_core") > 0)
    numbered = placed.withColumn("sent_no", F.row_number().over(order) - 1)
    return numbered.select(F.col("_tm_id").alias(ident), "sent_no", F.col("_tm_at").cast("long").alias("sent_start"), (F.col("_tm_at") + F.col("_tm_core")).cast("long").alias("sent_end"), "sentence")
