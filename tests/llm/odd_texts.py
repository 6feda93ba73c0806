"""Documents of every odd kind: (doc_id, text)."""

#: Nulls, empty and blank texts, ties and repeats, a very long text, odd white space.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (None, "a document without an identifier, but with words enough to keep"),
    (5, "one two"),
    (6, "  leading and  double   blanks\n\n\nand\tlines \r\n "),
    (7, "ünï çødé ñandú 中文 テキスト <|endoftext|> ▁mark"),
    (8, " ".join(f"word{i % 977}" for i in range(60_000))),
    (-9, "negative identifiers sort before the others do here"),
]
