"""File readers over real folders, and exports read back."""
import json

from framelens.operators import datasets as DS
from framelens.sources import annotations as A
from framelens.sources import runs as RU


def put(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def image_table(spark, n=3):
    return spark.createDataFrame([(i, f"im{i}", f"im{i}.jpg", 100, 50) for i in range(1, n + 1)],
                                 "image_id long, stem string, file_name string, width int, height int")


def test_label_folder(spark, tmp_path):
    folder = put(tmp_path / "labels", {
        "im1.txt": "0 0.5 0.5 0.2 0.4\r\n1 0.1 0.1 0 0.1\nshort line\n",
        "im2.txt": "x 0.5 0.5 0.2 0.4\n\n2 0.5 0.5 0.2 0.4", "im3.txt": "", "im9.txt": "0 0.5 0.5 0.2 0.4"})
    lines = A.read_label_lines(spark, folder)
    rows = A.yolo_boxes(lines, image_table(spark), 2).orderBy("image_id", "line_no").collect()
    assert [(r.image_id, r.line_no, r.cls, r.invalid) for r in rows] == [
        (1, 0, 0, False), (1, 1, 1, True), (2, 0, None, True), (2, 2, 2, True)]
    assert (rows[0].x, rows[0].y, rows[0].w, rows[0].h, rows[0].area) == (40.0, 15.0, 20.0, 20.0, 400.0)


def test_turned_label_folder(spark, tmp_path):
    folder = put(tmp_path / "obb", {"im1.txt": "1 0.1 0.1 0.3 0.1 0.3 0.3 0.1 0.3\n0 0 0 0 0 0 0 0 0", "im2.txt": "0 1 2 3"})
    rows = A.yolo_polygons(A.read_label_lines(spark, folder), image_table(spark), 2).orderBy("line_no").collect()
    assert [(r.image_id, r.cls, r.invalid) for r in rows] == [(1, 1, False), (1, 0, True)]
    assert rows[0].poly == [10.0, 5.0, 30.0, 5.0, 30.0, 15.0, 10.0, 15.0]


def test_aerial_folder(spark, tmp_path):
    folder = put(tmp_path / "aerial", {"P1.txt": "imagesource:x\ngsd:0.1\n1 2 3 2 3 4 1 4 ship 1\n1 2 3 2 3 4 1 4 rocket 0\n5 5 9 5 9 9 5 9 plane"})
    rows = A.aerial_polygons(A.read_label_lines(spark, folder)).orderBy("line_no").collect()
    assert [(r.line_no, r.cls, r.difficult) for r in rows] == [(2, "ship", 1), (4, "plane", 0)]
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"P1.txt"}


def test_voc_folder(spark, tmp_path):
    def box(name, x2):
        return f"<object><name>{name}</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>{x2}</xmax><ymax>9</ymax></bndbox></object>"
    folder = put(tmp_path / "voc", {"a.xml": f"<annotation><filename>a.jpg</filename>{box('cat', 5)}{box('cow', 5)}</annotation>",
                                    "b.xml": f"<annotation>\n<filename>b.jpg</filename>\n{box(' dog ', 1)}\n{box('dog', 3)}</annotation>"})
    rows = A.read_voc(spark, folder, ["cat", "dog"]).orderBy("filename", "obj_no").collect()
    assert [(r.filename, r.cls, r.w, r.invalid) for r in rows] == [
        ("a.jpg", 0, 4.0, False), ("a.jpg", -1, 4.0, True), ("b.jpg", 1, 0.0, True), ("b.jpg", 1, 2.0, False)]


def test_polygon_json_folder(spark, tmp_path):
    def doc(*shapes):
        return json.dumps({"imagePath": "x.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": [
            {"label": n, "shape_type": k, "points": p} for n, k, p in shapes]}, indent=1)
    folder = put(tmp_path / "lm", {"a.json": doc(("tree", "rectangle", [[0, 0], [4, 2]]), ("car", "polygon", [[0, 0], [4, 0], [0, 4]])),
                                   "b.json": doc(("", "polygon", [[0, 0], [4, 0], [0, 4]]), ("bus", "polygon", [[0, 0]]))})
    objs, listed = A.labelme_objects(A.read_labelme(spark, folder))
    assert {(r.label, r.category_id) for r in listed.collect()} == {("tree", 1), ("car", 2), ("bus", 3)}
    rows = objs.orderBy("path", "shape_no").collect()
    assert [(r.label, r.area, r.invalid) for r in rows] == [("tree", 8.0, False), ("car", 8.0, False), (None, 8.0, True), ("bus", rows[3].area, True)]


def test_image_folder(spark, tmp_path):
    put(tmp_path / "im" , {"b.JPG": "12", "a.png": "123", "notes.txt": "x"})
    put(tmp_path / "im" / "deep", {"c.jpeg": "1"})
    rows = A.image_listing(A.read_image_paths(spark, str(tmp_path / "im"))).orderBy("index").collect()
    assert [(r["index"], r.path.rsplit("/", 1)[1], r.size) for r in rows] == [(0, "a.png", 3), (1, "b.JPG", 2), (2, "c.jpeg", 1)]


def test_run_folder(spark, tmp_path):
    good = {"kind": "bbox", "AP": 0.5}
    for name in ("r1", "r2"):
        put(tmp_path / name, {"summary_a.json": json.dumps(good), "summary_conf3.json": "{}", "summary_b.json": "[1]",
                              "metrics_a.json": json.dumps({"note": "x", "engine": {"pipeline": {"avg_fps": 12.5}}})})
    texts = RU.read_texts(spark, str(tmp_path / "r*"))
    rows = RU.summaries(texts, texts.where("name like 'metrics_%'")).collect()
    assert sorted((r.dir.rsplit("/", 1)[1], r.tag, r.kind, r.AP, r.fps) for r in rows) == [
        ("r1", "a", "bbox", 0.5, 12.5), ("r2", "a", "bbox", 0.5, 12.5)]


def test_coco_files_stand_alone(spark, tmp_path):
    ann = spark.createDataFrame([(1, 1, 2, [1.0, 2.0, 3.0, 4.0], 12.0, 0), (2, 3, 1, [0.0, 0.0, 1.0, 1.0], 1.0, 0)],
                                "id long, image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    cats = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    path = tmp_path / "coco"
    DS.write_coco(DS.coco_documents(image_table(spark, 4), ann, cats, 2), str(path))
    docs = [json.loads(f.read_text()) for f in path.glob("part-*")]
    assert sorted([i["id"] for i in d["images"]] for d in docs) == [[1], [2, 3], [4]]
    assert all([c["name"] for c in d["categories"]] == ["a", "b"] for d in docs)
    assert all({a["image_id"] for a in d["annotations"]} <= {i["id"] for i in d["images"]} for d in docs)
    back = A.read_coco(spark, str(path))
    assert {k: v.count() for k, v in back.items()} == {"images": 4, "annotations": 2, "categories": 2}


def test_oriented_lines_with_empty_patches(spark, tmp_path):
    patches = spark.createDataFrame([("p1",), ("p2",)], "patch string")
    objs = spark.createDataFrame([("p1", 7, "ship", 1, [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]), ("p1", 3, "plane", 0, [0.0] * 8)],
                                 "patch string, gt_idx long, cls string, difficult int, poly array<double>")
    DS.oriented_lines(patches, objs).select("value").write.text(str(tmp_path / "gt"))
    found_patches, found = A.read_oriented(spark, str(tmp_path / "gt"))
    assert {r.patch for r in found_patches.collect()} == {"p1", "p2"}
    assert sorted((r.image, r.gt_idx, r.cls, r.difficult, len(r.poly)) for r in found.collect()) == [("p1", 0, "plane", 0, 4), ("p1", 1, "ship", 1, 4)]
