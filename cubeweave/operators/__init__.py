"""Array operators. Cells are rows (v, s, t, h, w, x): variable, section, time, height, width, value."""
