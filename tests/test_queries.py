import duckdb
import pytest

from stocktake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "a4_a5_original_sizes", "a6_actual_sizes", "a8_game_completion", "a10_game_completion_non_merged", "a11_game_completion_jbfolder", "a13_system_completion_dispatch", "a20_set_cover", "f4_systems_like", "f25_trashed_romfiles_global",
    "j3_romfiles_of_system", "j6_orphan_romfiles", "j21_closest_name", "k1_insert", "k4_delete_games", "m1_assignment", "m1_tiers", "p2_resolved_parents", "p3_changed_roms", "p5_sorting", "p8_check", "p8_check_archives", "p9_convert_chd",
    "p9_convert_7z", "p9_convert_cso", "p9_convert_zip", "p10_export_iso", "p10_export_zip", "p10_export_gdi", "u4_game_classes", "j16_foreign_files", "p13_purge_plan", "k2_update",
    "f27_settings", "p19_add", "p19_remove", "p19_unset", "p19_invalid", "t7_children_first", "p16_parent_images", "t12_hash_order", "j20_zipped_tracks", "a19_extents", "m9_new_patches", "a17_unique_paths", "j18_not_imported", "x20_human_sizes", "x23_version_gate",
    "p1_import_catalogues", "p1_systems", "p1_games", "p3_orphans", "m3_import_files", "m2_route", "m4_members", "m5_discs", "m6_packages", "m7_folders", "m8_import_listings", "m8_orphans", "m8_purge_listings", "m9_import_patches",
    "m9_patch_files", "j8_find_md5_item_arcade", "j8_find_crc_game_all", "j9_find_present_sha1", "j14_roms_by_romfile", "j15_vanished_roms", "a14_clones_by_parent", "x10_regions_of_codes",
    "p11_playlists", "p14_purge_systems", "p20_ignored_roms", "t4_ranked_families", "t6_move_plan", "x7_sorted_paths", "x9_name_information", "f28_x2_headered_hash",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert len(at) == len(cursor.description)
    assert got == sorted((tuple(r[k] for k in at) for r in cursor.fetchall()), key=repr)


def test_every_query_has_a_name_of_its_own():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], check=True)


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
