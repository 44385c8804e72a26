"""Pages with many strong lines."""

import numpy as np

from docraster.operators.detect import find_lines


def test_the_border_counts_among_many_stronger_inner_lines():
    """Ruled inside by over 60 strong lines; the border has gaps, and so fewer votes than each of them."""
    img = np.full((900, 1200), 30, np.uint8)
    img[50:850, 60:1140] = 235
    for k in range(70):
        img[95 + 10 * k : 98 + 10 * k, 100:1100] = 30
    img[50:850, 400:800][[0, 1, 2, -3, -2, -1]] = 30
    img[40:56, 350:850] = img[844:860, 350:850] = 30
    q = find_lines(img)
    assert q is not None and np.abs(q - [[60, 50], [1140, 50], [1140, 850], [60, 850]]).max() < 15, q
