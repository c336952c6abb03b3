"""The public operators in one place, under the names that speech scientists know them by.

All take and give DataFrames. Signals are rows (*keys, fs, y); tiers are rows (*keys, t1, t2, label).
"""

from tierloom.dsp.hearing import AuditoryModel as Audspec
from tierloom.functions.scales import bark2hz, hz2bark, shannon_bands, third_octave_bands, third_octave_bounds
from tierloom.operators.asof import adjust_boundaries, contained, interpolate, interpolate_positions, match_frames, merge_tiers, nearest
from tierloom.operators.norm import delta_f, delta_f_norm
from tierloom.operators.tiers import add_context, contour, explode_intervals, fill_gaps, nonzero_runs, overlaps, split_speakers, validate_tier
from tierloom.operators.workflow import measure_texts, missing, process_missing, read_measures, translate, with_metadata
from tierloom.signal.measures import (
    add_noise,
    add_noise_and_norm,
    amplitude_envelope,
    apply_filterbank,
    auditory,
    burst,
    compute_sgram,
    egg_to_oq,
    fricative,
    get_f0,
    get_f0_acd,
    get_f0_cor,
    get_f0_srh,
    get_rhythm_spectrum,
    peak_rms,
    prep_audio,
    rhythmogram,
    sgram,
    sigcor_noise,
    sine_synth,
    smoothn,
    track_formants,
    vocode,
)
from tierloom.signal.samplers import formant_to_df, intensity_to_df, mfcc_to_df, pitch_to_df
from tierloom.sources.files import npz_contents, write_files
from tierloom.sources.listing import list_files
from tierloom.sources.srt import read_srt
from tierloom.sources.textgrid import read_textgrid, textgrid_text, write_textgrids
from tierloom.sources.wav import load_chunks, load_signals

tg_to_df, df_to_tg, srt_to_df, loadsig, dir2df = read_textgrid, textgrid_text, read_srt, load_signals, list_files
interpolate_measures, match_tokentimes, split_speaker_df, nonzero_groups = interpolate, match_frames, split_speakers, nonzero_runs
get_deltaF, deltaF_norm = delta_f, delta_f_norm

__all__ = [n for n in dir() if not n.startswith("_")]
