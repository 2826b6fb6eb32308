"""Texts for the tests of this folder."""


def words(n, start=0, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(start, start + n))


#: Nulls, empty and blank texts, ties, repeats and one long text.
ODD = [None, "", " \t\n ", "x", "x", "...", "日本語 テスト", "a\x00b c", "under the mit license", words(200), words(200), words(6000) + " " + words(6000)]
