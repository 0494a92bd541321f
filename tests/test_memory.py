"""Python memory of the kernels: bounded by a run or slice, not by the batch that Spark sends."""

import tracemalloc

import pyarrow as pa

from lexstrata.functions import html, kernels


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_kernels_hold_a_short_run():
    texts = pa.array([f"The {i} quick words don't repeat; number {i * 7} ends here. " * 20 for i in range(4000)])
    assert peak(lambda: kernels.style(texts)) < 60e6
    assert peak(lambda: kernels.embed(texts, 16)) < 60e6


def test_pages_are_parsed_in_slices():
    pages = pa.array([f"<title>{i}</title><p>{'some text ' * 900}</p>" for i in range(700)])
    assert peak(lambda: html.parse_html.func(pages)) < 6e6
    assert html.parse_html.func(pages).field("title").to_pylist() == [str(i) for i in range(700)]
    assert len(html.parse_html.func(pages[:0])) == 0


def test_words_are_told_apart_in_each_text():
    texts = pa.array(["a b a b c", "", None, "a", "b a", "x " * 300])
    assert [round(x * n) for x, n in zip(kernels.style(texts).field("type_token_ratio").to_pylist(), (5, 0, 0, 1, 2, 300))] == [3, 0, 0, 1, 2, 1]
