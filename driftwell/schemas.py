"""Schemas of the logical tables. They are always given to readers: inference would turn maps into huge structs."""

from __future__ import annotations

FINDING = "struct<ident:string,severity:string,confidence:string,route:string>"
KEYED = "struct<ident:string,route:string>"
FILE = "struct<file_path:string,file_hash:string,previous_file_hash:string>"
FIX_FILE = f"struct<file_path:string,before:string,after:string,scan_status:string,V_fixed:array<{KEYED}>,V_introduced:array<{KEYED}>>"

SCHEMAS = {
    "workflow_index": "repository string, commit_hash string, committed_date string, file_path string, file_hash string, previous_file_hash string, git_change_type string, valid_yaml string, valid_workflow string, probably_workflow string",
    "blobs": "file_hash string, content binary",
    "sampled_commits": f"repository string, commit_hash string, committed_date string, files array<{FILE}>",
    "diffs": "repository string, commit_hash string, file_path string, file_hash string, previous_file_hash string, added map<string,string>, removed map<string,string>, changed map<string,array<string>>, parse_error boolean",
    "scans": f"file_hash string, ok boolean, error string, findings array<{FINDING}>",
    "clean_fix_index": "dir string, repository string, commit_hash string, V_fixed_count int, V_fixed_idents array<string>, n_files_modified int",
    "clean_fix_meta": f"repository string, commit_hash string, github_url string, V_fixed_count int, V_fixed_idents array<string>, n_files_modified int, files array<{FIX_FILE}>",
    "classification": "repository string, commit_hash string, kind string, dir string",
    "patterns": "fixes array<string>, n_commits bigint, n_subclusters bigint, structural_subclusters array<struct<template_hash:string,template_lines:array<string>,n_commits:bigint,exemplars:array<struct<repository:string,commit_hash:string>>>>",
    "gaps": "repository string, commit_hash string, branch string, default_branch string, status string, V_fixed_idents array<string>, verdict string, n_scan_failed bigint, idents_present array<string>",
    "history": "repository string, commit_hash string, branch string, path string, status string, reason string, backport_version string, backported_at timestamp_ntz, n_read bigint, lag_days double, refined string",
    "outcomes": "repository string, commit_hash string, processed_at string, source string, outcome string, reason string, error string",
    "edits": "program string, ordinal int, op string, anchor array<string>, key string, value string, pin_action string, expected_old string, review string",
    "patches": "program string, target string, patched_text string, text_changed boolean",
    "edit_outcomes": "program string, target string, ordinal int, op string, status string, sites bigint, reason string, site_paths array<string>",
    "patch_runs": "program string, target string, status string, n_edits bigint, n_applied bigint, n_created bigint, n_noop bigint, n_inapplicable bigint, n_needs_review bigint, changed boolean, needs_review boolean, fully_applied boolean, text_changed boolean, n_scopes bigint, n_failed bigint, n_introduced bigint, success boolean, n_lint bigint, accepted boolean, bucket string",
    "cases": "program string, target string, name string, text string",
    "export": "dir string, name string, text string",
    "repos": "repository string, default_branch string",
    "branches": "repository string, branch string, head_sha string",
    "commit_on_branch": "repository string, branch string, commit_hash string, reachable boolean",
    "file_at_ref": "repository string, ref string, path string, content binary, blob_sha string, missing boolean",
    "file_history": "repository string, branch string, path string, seq int, commit_sha string, committed_at string",
    "commit_info": "repository string, commit_sha string, committed_at string, parent_sha string",
    "ref_resolution": "action string, ref string, sha string",
    "lint_findings": "text_hash string, kind string, message string",
}
