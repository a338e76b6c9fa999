"""Regular expressions shared by the Catalyst expressions and the SQL counterparts.

None uses look-around; WORD is read alike by java.util.regex, RE2 and Python's regex.
"""

#: A word of Latin-letter text by the default word boundary rules: letters with
#: joiners between them, digits with separators between them, underscores around.
WORD = (
    r"(?:_*[\p{L}\p{M}]+(?:[.:'’·‧][\p{L}][\p{L}\p{M}]*)*"
    r"|_*\p{Nd}+(?:[.,;'’]\p{Nd}+)*)+_*"
)

#: WORD for java.util.regex and Python, which can be told not to step back: it finds the same.
FAST_WORD = (
    r"(?:_*+[\p{L}\p{M}]++(?:[.:'’·‧]\p{L}[\p{L}\p{M}]*+)*+"
    r"|_*+\p{Nd}++(?:[.,;'’]\p{Nd}++)*+)++_*+"
)
#: What WORD or a count of single characters can't judge, as `regex` reads it: letters of
#: other scripts, marks, emoji and what joins them, runs of underscores.
DIFFICULT = r"[^\p{Script=Latin}\P{L}]|[\p{M}\p{Nl}\p{Cf}\p{Co}\p{Cs}]|[\u200D\uFE0F\u20E3\u2600-\u27BF\u2B00-\u2BFF\U0001F000-\U0001FAFF]|__"
