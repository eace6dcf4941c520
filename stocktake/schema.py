"""Codes and table shapes of the collection model."""

from __future__ import annotations

# Completion of an entry or collection.
NONE, PARTIAL, FULL = 0, 1, 2
# Sorting of an entry.
ALL_REGIONS, ONE_REGION, IGNORED = 0, 1, 2
# Merging mode of an arcade collection.
SPLIT, NON_MERGED, MERGED, FULL_NON_MERGED, FULL_MERGED = 0, 1, 2, 3, 4
# Kind of a stored file.
ROMFILE, PATCHFILE, PLAYLIST = 0, 1, 2

SYSTEMS = "id bigint, name string, custom_name string, custom_extension string, description string, version string, url string, completion int, arcade boolean, merging int"
GAMES = (
    "id bigint, name string, description string, comment string, external_id string, device boolean, bios boolean, jbfolder boolean, regions string, "
    "sorting int, completion int, system_id bigint, parent_id bigint, bios_id bigint, playlist_id bigint"
)
ROMS = "id bigint, name string, bios boolean, disk boolean, size bigint, crc string, md5 string, sha1 string, rom_status string, game_id bigint, romfile_id bigint, parent_id bigint, original boolean"
ROMFILES = "id bigint, path string, size bigint, parent_id bigint, romfile_type int"
PATCHES = "id bigint, name string, index int, rom_id bigint, romfile_id bigint"
HEADERS = "id bigint, name string, version string, size bigint, system_id bigint"
RULES = "id bigint, start_byte bigint, hex_value string, header_id bigint"
SETTINGS = "id bigint, key string, value string"

ARCHIVE_EXTENSIONS = ("7z", "zip")
PS3_EXTENSIONS = ("pkg", "pup", "rap")
NON_ORIGINAL_EXTENSIONS = ("7z", "zip", "chd", "cso", "nsz", "rvz", "zso")
