"""Array kernels by hand-computed values and by properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from docraster.functions import codec
from docraster.functions import kernels as K
from docraster.operators import detect
from docraster.plans.pipeline import Settings, enhanced


def document(h=700, w=900, quad=((170, 90), (760, 130), (700, 610), (130, 560))):
    """A bright page with a black border and lines of text on a dark ground."""
    q = np.array(quad, float)
    y, x = np.mgrid[0:h, 0:w]
    depth = np.full((h, w), np.inf)  # inside the page: the distance from its edge
    for a, b in zip(q, np.roll(q, -1, axis=0)):
        depth = np.minimum(depth, ((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])) / np.hypot(*(b - a)))
    img = np.where(depth >= 4, 245, np.where(depth >= -4, 15, 35)).astype(np.uint8)
    for top in range(170, 531, 40):
        img[top : top + 4, 260:600] = 40
    return np.repeat(img[..., None], 3, axis=2)


PAGE = document()


def test_gray_and_gain():
    img = np.full((2, 3, 3), (40, 80, 120), np.uint8)
    assert (K.to_gray(img) == round(0.114 * 40 + 0.587 * 80 + 0.299 * 120)).all()
    assert K.to_gray(K.to_gray(img)).shape == (2, 3)
    assert K.gain_bias(np.array([[10, 100, 250]], np.uint8), 1.0, -80).tolist() == [[70, 20, 170]]
    assert K.gain_bias(np.array([[51, 5]], np.uint8), 2.5, 0).tolist() == [[128, 12]]  # 127.5 and 12.5, half to even
    assert K.binary(np.array([[170, 171]], np.uint8), 170).tolist() == [[0, 255]]


def test_constant_images_stay_as_they_are():
    img = np.full((30, 40, 3), 90, np.uint8)
    for f in (K.sharpen, lambda a: K.non_local_means(a, 4), lambda a: K.deskew(a)[0], lambda a: K.shrunk(a, 20)[0]):
        assert set(np.unique(f(img))) == {90}
    assert set(np.unique(K.black_and_white(img))) == {255}


def test_blur_of_a_point_is_its_taps():
    img = np.zeros((9, 9), np.uint8)
    img[4, 4] = 200
    assert np.allclose(K.gaussian(img, 5, 1.0)[2:7, 2:7], 200 * np.outer(K.gaussian_taps(5, 1.0), K.gaussian_taps(5, 1.0)))


def test_enhancement_ends_in_two_values_if_asked():
    out = enhanced(PAGE[::10, ::10], Settings(1.45, 8, 1, 165, True))
    assert out.ndim == 2 and set(np.unique(out)) <= {0, 255}


@settings(max_examples=40, deadline=None)
@given(hnp.arrays(np.uint8, st.tuples(st.integers(1, 12), st.integers(1, 12))))
def test_properties_of_images(img):
    assert (np.rot90(img, 4) == img).all()
    assert (np.concatenate(K.halves(img), axis=1) == img).all()
    assert (codec.png_image(codec.png_bytes(img)) == img).all()
    colour = np.stack([img, 255 - img, img // 2], -1)
    assert (codec.png_image(codec.png_bytes(colour)) == colour).all()
    assert all((a == b).all() for a, b in zip(codec.pdf_images(codec.pdf_bytes([img, colour])), [img, colour]))
    labels, n = K.components(img > 127)
    assert n == len(np.unique(labels[img > 127])) and (labels[img <= 127] == 0).all()


def test_components_are_joined_at_corners():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 1, 0, 1]], bool)
    labels, n = K.components(m)
    assert n == 4 and labels[0, 0] == labels[1, 1] and labels[2, 3] == labels[3, 3]


def test_outline_and_simplification_of_a_rectangle():
    m = np.zeros((40, 60), bool)
    m[5:30, 10:50] = True
    q = K.simplified(K.outline(m), 2)
    assert {tuple(p) for p in q.astype(int).tolist()} == {(10, 5), (49, 5), (49, 29), (10, 29)}
    box, angle = K.min_area_rect(K.outline(m))
    assert angle == 0 and K.polygon_area(box) == 39 * 24


def test_order_and_warp():
    q = K.order_quad(np.array([(90, 10), (15, 120), (100, 130), (10, 20)], float))
    assert q.tolist() == [[10, 20], [90, 10], [100, 130], [15, 120]]
    img = np.zeros((120, 140, 3), np.uint8)
    img[20:100, 30:110] = 255
    out = K.warp(img, np.array([(30, 20), (110, 20), (110, 100), (30, 100)]))
    assert out.shape[0] >= 70 and out.shape[1] >= 70 and out[5:-5, 5:-5].min() > 200
    h, w = img.shape[:2]
    whole = K.warp(img, np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]))
    assert np.abs(whole[: h - 1, : w - 1].astype(int) - img[: h - 1, : w - 1]).mean() < 3


def test_deskew_levels_a_turned_block():
    y, x = np.mgrid[0:160, 0:220]
    t = np.deg2rad(17)
    u, v = np.cos(t) * (x - 110) + np.sin(t) * (y - 80), -np.sin(t) * (x - 110) + np.cos(t) * (y - 80)
    img = np.where((abs(u) < 70) & (abs(v) < 30), 0, 255).astype(np.uint8)
    out, angle = K.deskew(img)
    assert out.shape == img.shape and abs(angle - 17) < 1.5
    assert abs(K.deskew(out)[1]) < 1.5
    assert K.deskew(np.full((10, 10), 255, np.uint8))[1] == 0.0


@pytest.mark.parametrize("backend", ["opencv_quad", "opencv_hough", "opencv_minrect", "cv_hybrid"])
def test_detectors_find_the_page(backend):
    s, errors = detect.scan(PAGE, [backend])
    assert s.detected and s.backend == backend and not errors
    if backend == "opencv_hough":  # the others score by area, so the ground's own outline may win
        assert np.abs(s.contour - np.array([(170, 90), (760, 130), (700, 610), (130, 560)])).max() < 25
    assert min(s.warped.shape[:2]) > 350


def test_detection_falls_back_and_tells_why():
    blank = np.zeros((240, 320, 3), np.uint8)
    s, errors = detect.scan(blank, ["cv_hybrid"])
    assert not s.detected and s.reason == "low_variance" and s.warped is None and not errors
    s, errors = detect.scan(PAGE, ["nonsense", "uvdoc", "opencv_quad"])
    assert s.detected and s.backend == "opencv_quad"
    assert errors[0] == "nonsense: Unsupported detector backend: nonsense" and errors[1].startswith("uvdoc: ")
    model = {"uvdoc": detect.by_model("uvdoc", lambda img: [{"doctr_img": img[:300, :240] / 1.0}])}
    s, _ = detect.scan(PAGE, ["uvdoc"], model)
    assert s.detected and s.contour is None and s.warped.shape == (300, 240, 3)
