from blockweave.functions import tables as T


def test_zigzag_is_a_permutation_with_known_turns():
    assert sorted(T.ZIGZAG) == list(range(64))
    assert T.ZIGZAG[:10] == (0, 1, 8, 16, 9, 2, 3, 10, 17, 24) and T.ZIGZAG[-1] == 63


def test_huffman_tables_are_complete_prefix_codes():
    for kind, group in T.HUFFMAN:
        bits, symbols = T.HUFFMAN[kind, group]
        assert sum(bits) == len(symbols) == len(set(symbols)) == (12 if group == "dc" else 162)
        codes = T.codes(kind, group)
        words = sorted(format(c, f"0{n}b") for c, n in codes.values())
        assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))
        assert all(set(w) != {"1"} for w in words)  # no code of ones only


def test_quality_scaling():
    assert T.quant("luma", 50) == T.LUMA
    assert T.quant("luma", 100) == (1,) * 64 == T.quant("luma", 1000)
    assert T.quant("luma", 0) == T.quant("luma", 1) and max(T.quant("chroma", 1)) == 255
    assert T.quant("luma", 75)[:3] == (8, 6, 5)
