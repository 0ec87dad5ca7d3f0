import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a very long text, odd characters."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\r"),
        (4, "one two three"),
        (4, "one two three"),
        (5, "One  two\nthree"),
        (None, "one two three"),
        (6, "word " * 30_000),
        (7, "Ünïcödé    nbsp \x1c sep 　 wide don't <|endoftext|> x"),
        (8, "a b c d e f g h i j k l m n o p"),
        (9, None, None),
    ]
