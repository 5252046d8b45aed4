"""Files of mixed layouts."""

import json

from crownwork.sources import readers


def test_box_files_of_mixed_layouts(spark, tmp_path):
    d = tmp_path / "some boxes+"
    d.mkdir()
    (d / "a.csv").write_text("image_path,xmin,ymin,xmax,ymax,label\nA.tif,1,2,3,4,Tree\n")
    (d / "b c.csv").write_text("label,image_path,ymin,xmin,ymax,xmax\nTree,B.tif,2,1,4,3\n")
    (d / "c.csv").write_text('image_path,xmin,ymin,xmax,ymax,label,shadow_angle,shadow_x,shadow_y,domain,more\n"C, x.tif",1,2,3,4,Tree,215.5,0.1,-0.2,WON,?\nD.tif,x,2,3,,Tree,,,,,\n')
    (d / "empty.csv").write_text("")
    got = sorted((tuple(r) for r in readers.read_box_csv(spark, str(d)).collect()), key=str)
    none = (None,) * 4
    assert got == [("A.tif", 1, 2, 3, 4, "Tree", *none), ("B.tif", 1, 2, 3, 4, "Tree", *none), ("C, x.tif", 1, 2, 3, 4, "Tree", 215.5, 0.1, -0.2, "WON"), ("D.tif", None, 2, 3, None, "Tree", *none)]


def test_shapes_of_all_types(spark, tmp_path):
    ring = lambda k: [[k, 0], [k + 1, 0], [k + 1, 1.5], [k, 0]]
    hole = [[0.2, 0.2], [0.3, 0.2], [0.3, 0.3], [0.2, 0.2]]
    multi = {"type": "MultiPolygon", "coordinates": [[ring(1)], [ring(2), hole]]}
    shapes = [{"type": "Polygon", "coordinates": [ring(0), hole]}, multi, {"type": "GeometryCollection", "geometries": [multi, {"type": "Point", "coordinates": [1, 2]}, {"type": "Polygon", "coordinates": [ring(7)]}]}, {"type": "Point", "coordinates": [1, 2]}, None, {"type": "Polygon", "coordinates": "junk"}]
    features = [{"type": "Feature", "properties": {"tree_id": k, "score": k / 10}, "geometry": g} for k, g in enumerate(shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    got = {(r["tree_id"], r["part"]): None if r["ring"] is None else [[p["x"], p["y"]] for p in r["ring"]] for r in readers.read_predictions_geojson(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): ring(0), (1, 0): ring(1), (1, 1): ring(2), (2, 0): ring(1), (2, 1): ring(2), (2, 2): ring(7), (3, 0): None, (4, 0): None, (5, 0): None}
